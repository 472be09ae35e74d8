"""Resumable ingest: every new file of a folder is read once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkprism.functions.text import strip
from linkprism.operators.links import exploded_links, prompt_links
from linkprism.operators.rules import SIGNATURES, matched, prefilter
from linkprism.sources.files import PAGE, is_object, page_rows


def page_stream(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """Pages of JSON lines, as in a batch; ``files_per_trigger`` bounds a micro-batch.

    Lines that hold no object are skipped and counted: the progress of the query has
    ``lines`` with n_lines and n_errors.
    """
    lines = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", files_per_trigger).text(folder).where(strip(F.col("value")) != "")
    ok = is_object(F.col("value"))
    counted = lines.observe("lines", F.count(F.lit(1)).alias("n_lines"), F.count_if(~ok).alias("n_errors"))
    return page_rows(counted.where(ok).select(F.from_json("value", PAGE).alias("r")).select("r.*"))


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, crawl: str, files_per_trigger: int = 64) -> StreamingQuery:
    """Append the prompt links of files not seen before, exactly once, then stop; run again to resume."""
    found = prompt_links(page_stream(spark, folder, files_per_trigger), crawl)
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def filtered_lines(spark: SparkSession, folder: str, signatures=SIGNATURES) -> DataFrame:
    """Raw lines whose target address belongs to a platform, as a stream."""
    lines = spark.readStream.option("lineSep", "\n").text(folder).where(prefilter(F.col("value"), signatures))
    return matched(lines.withColumn("target_url", F.get_json_object("value", "$.target_url")), "target_url", signatures).where("target_platform is not null").select("value", "target_platform")


__all__ = ["exploded_links", "filtered_lines", "ingest", "page_stream"]
