"""Readers: path lists, raw lines, JSON lines (strict and permissive), CSV, JSON, rankings, pages."""

from __future__ import annotations

import gzip
import io
import json
import os
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkprism.functions.text import strip
from linkprism.runtime import exists, listing, read_text
from linkprism.sources.wat import opened

# Fixed value: where crawls are published.
REMOTE_ROOT = "https://data.commoncrawl.org"
LINK = "struct<url:string,path:string,href:string,text:string,anchor:string,alt:string>"
PAGE = f"source_url string, url string, links array<{LINK}>"
#: Superset of the fields of prompt links and classified links; absent fields are null.
ROW = (
    "crawl string, wat_file string, source_url string, source_domain string, target_url string, target_domain string, target_platform string, "
    "anchor_text string, link_path string, primary_prompt_text string, prompt_labels array<string>, tier2_labels array<string>, classification string, "
    "severity string, tier2_severity string, prompt_parameters map<string,array<string>>"
)


def path_list(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """Non-blank trimmed lines of a plain or gzip list with their order; ``limit`` 0 keeps all."""
    lines = spark.read.text(path).select(strip(F.col("value")).alias("path")).where("path <> ''")
    return lines.limit(limit) if limit > 0 else lines


def local_paths(spark: SparkSession, path: str, limit: int = 0) -> list[str]:
    """The same list on the driver, in its order: it is one line per input file."""
    lines = [r["path"] for r in path_list(spark, path).coalesce(1).collect()]
    return lines[:limit] if limit > 0 else lines


def remote_paths(crawl: str, url: str | None = None, limit: int = 0, remote_root: str = REMOTE_ROOT) -> list[str]:
    """The lines of a crawl's published list of metadata files: one line per input file, fetched by the driver."""
    with opened(url or f"{remote_root}/crawl-data/{crawl}/wat.paths.gz") as f:
        data = f.read()
    text = (gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data).decode("utf-8", "replace")
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    return lines[:limit] if limit > 0 else lines


def resolve(spark: SparkSession, item: str, base_dir: str, remote_root: str = REMOTE_ROOT) -> str:
    """A URL stays; a path that exists beside the list is taken from there; anything else goes under the remote root."""
    if "://" in item:
        return item
    local = f"{base_dir.rstrip('/')}/{item}"
    if not exists(spark, local):
        return f"{remote_root}/{item.lstrip('/')}"
    return local if "://" in local else f"file://{os.path.abspath(local)}"


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as they are, split at newline only; large plain files are read in ranges, gzip files whole."""
    return spark.read.option("lineSep", "\n").text(path)


def is_object(line: Column) -> Column:
    """True for a line that holds a JSON object; wrong-typed nested fields do not matter."""
    return F.json_object_keys(line).isNotNull()


def json_lines(spark: SparkSession, path: str, schema: str = ROW) -> DataFrame:
    """Permissive: (value, is_error, row); blank lines are left out."""
    filled = F.trim(F.regexp_replace("value", r"[\r\n]", "")) != ""
    ok = is_object(F.col("value"))
    # The optimizer may evaluate the error before the filter, so the error repeats the condition.
    return raw_lines(spark, path).where(filled).select("value", (~ok & filled).alias("is_error"), F.when(ok, F.from_json("value", schema)).alias("row"))


def json_rows(spark: SparkSession, path: str, schema: str = ROW) -> DataFrame:
    """Strict: a line that is no JSON object fails the query."""
    parsed = json_lines(spark, path, schema)
    checked = F.when(F.col("is_error"), F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("value", 1, 200)))).otherwise(F.col("row"))
    return parsed.select(checked.alias("row")).select("row.*")


def page_rows(rows: DataFrame) -> DataFrame:
    """source_url (or url, where that is blank) and links of parsed pages; pages without address or links are left out."""
    return rows.select(F.coalesce(F.nullif(strip(F.col("source_url")), F.lit("")), strip(F.col("url"))).alias("source_url"), "links").where("source_url <> '' and links is not null")


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Fixture pages of JSON lines, see ``page_rows``."""
    return page_rows(json_rows(spark, path, PAGE))


def csv_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with header, all values strings, doubled quotes."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(path, header=True, schema=schema, escape='"', multiLine=True, lineSep=None)


def json_object(spark: SparkSession, path: str) -> dict:
    out = json.loads(read_text(spark, path))
    if not isinstance(out, dict):
        raise RuntimeError(f"{path} does not hold a JSON object")
    return out


def _ranking_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a plain or gzip list, or of the first file in a zip archive (a ranking has about a million lines)."""
    if not path.endswith(".zip"):
        return spark.read.text(path)
    data = spark.read.format("binaryFile").load(path).first()["content"]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        lines = z.read(z.namelist()[0]).decode("utf-8", "replace").splitlines()
    return spark.createDataFrame([(x,) for x in lines], "value string")


def ranking(spark: SparkSession, path: str) -> DataFrame:
    """(domain, rank) from 'rank,domain' lines; malformed lines are left out, of equal domains the last counts."""
    parts = F.split("value", ",", 2)
    lines = _ranking_lines(spark, path).select(F.try_to_number(F.trim(parts[0]), F.lit("9999999999")).cast("int").alias("rank"), F.lower(F.trim(F.get(parts, 1))).alias("domain"), F.monotonically_increasing_id().alias("o"))
    return lines.where("rank is not null and domain <> ''").groupBy("domain").agg(F.max_by("rank", "o").alias("rank"))


def load_ranking(spark: SparkSession, csv: str | None = None, cache: str | None = None) -> tuple[DataFrame, str]:
    """An explicit file, else the cached one, else an empty ranking; with the source's name."""
    for path, source in ((csv, "csv"), (cache, "cache")):
        if path and exists(spark, path):
            return ranking(spark, path), source
    return spark.createDataFrame([], "domain string, rank int"), "none"


def classified_input(spark: SparkSession, run_root: str, stem: str = "classified_prompt_links") -> str:
    """Exact .jsonl, exact .jsonl.gz, else the only match of a pattern."""
    root = run_root.rstrip("/")
    for name in (f"{stem}.jsonl", f"{stem}.jsonl.gz"):
        if exists(spark, p := f"{root}/{name}"):
            return p
    found = listing(spark, root, f"*{stem}*.jsonl*")
    if not found:
        raise FileNotFoundError(f"no classified input in {run_root}")
    if len(found) > 1:
        raise RuntimeError(f"several classified inputs in {run_root}: {found}")
    return f"{root}/{found[0]}"


def runs_base(spark: SparkSession, path: str) -> str | None:
    """The value of the only line that starts with 'runs_base:'."""
    for line in read_text(spark, path).splitlines():
        if line.startswith("runs_base:"):
            return line.split(":", 1)[1].strip().strip("\"'") or None
    return None
