"""Sinks: JSON lines, verbatim lines, CSV, JSON, manifest, and the guard of output folders."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkprism.runtime import filesystem, listing, write_text


def guard(spark: SparkSession, path: str, allow_existing: bool = False, overwrite: bool = False) -> None:
    """Refuse a non-empty folder, on whatever file system, unless told otherwise; ``overwrite`` removes it."""
    if overwrite:
        fs, at = filesystem(spark, path)
        fs.delete(at, True)
    if listing(spark, path) and not allow_existing:
        raise FileExistsError(f"{path} is not empty")


def json_lines(df: DataFrame, path: str, mode: str = "errorifexists", compression: str | None = None) -> None:
    w = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode)
    (w.option("compression", compression) if compression else w).text(path)


def lines(df: DataFrame, path: str, value: str = "value", mode: str = "errorifexists", files: int = 0) -> None:
    """Lines as they are; ``files`` > 0 merges the parts into so many files."""
    out = df.select(F.col(value).alias("value"))
    (out.coalesce(files) if files else out).write.mode(mode).option("lineSep", "\n").text(path)


def csv(df: DataFrame, path: str, columns: list[str], mode: str = "errorifexists") -> None:
    """Header, fixed column order, minimal quoting with doubled quotes, CRLF; null is an empty value, a column beside ``columns`` an error."""
    if extra := set(df.columns) - set(columns):
        raise ValueError(f"columns not in the table: {sorted(extra)}")
    out = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    out.write.mode(mode).csv(path, header=True, escape='"', emptyValue="", lineSep="\r\n")


def json_file(spark: SparkSession, obj: dict, path: str) -> None:
    write_text(spark, path, json.dumps(obj, indent=2, ensure_ascii=False) + "\n")


def manifest(spark: SparkSession, script: str, crawl: str, source: str, output_dir: str, folders: tuple[str, ...] = ("tables", "review")) -> dict:
    out = {"script": script, "version": 1, "crawl": crawl, "input": source, "output_dir": output_dir}
    for f in folders:
        out[f] = [f"{output_dir}/{f}/{x}" for x in listing(spark, f"{output_dir}/{f}")]
    return out | {"summary_json": f"{output_dir}/summary.json"}
