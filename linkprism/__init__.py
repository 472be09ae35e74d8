"""Spark-first analytics for links that open an assistant with a prepared prompt.

Every stage is a function from DataFrame to DataFrame; rule tables are data,
rules become Catalyst expressions, and nothing is collected inside a transform
unless its size is bounded and the bound is stated.
"""

__version__ = "0.1.0"
