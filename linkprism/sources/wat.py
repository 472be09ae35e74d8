"""A Python data source for gzip WARC metadata records; one input partition per file."""

from __future__ import annotations

import gzip
import http.client
import io
import json
import urllib.request
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "wat_file string, source_url string, links array<struct<url:string,path:string,href:string,text:string,anchor:string,alt:string>>, error string"
#: Seconds that a server may be silent.
TIMEOUT = 60
_FIELDS = ("url", "path", "href", "text", "anchor", "alt")


def _records(f: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, body) of each WARC record."""
    while True:
        line = f.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            continue
        headers: dict[str, str] = {}
        while (line := f.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            headers[k.strip().lower()] = v.strip()
        yield headers, f.read(int(headers.get("content-length") or 0))


def _links(body: bytes) -> list[tuple] | None:
    """Links of a metadata envelope; every level must be an object; null for broken JSON."""
    try:
        node = json.loads(body)
    except ValueError:
        return None
    for k in ("Envelope", "Payload-Metadata", "HTTP-Response-Metadata", "HTML-Metadata"):
        node = node.get(k) if isinstance(node, dict) else None
    found = node.get("Links") if isinstance(node, dict) else None
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    return [tuple(text(x.get(k)) for k in _FIELDS) for x in found if isinstance(x, dict)] if isinstance(found, list) else []


def opened(path: str) -> io.BufferedIOBase:
    """A stream of a local file, an address on the web or a file of another file system; it is read as it arrives."""
    if path.startswith(("http://", "https://")):
        return io.BufferedReader(urllib.request.urlopen(path, timeout=TIMEOUT))
    if "://" in path and not path.startswith("file://"):
        fs, name = pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
        return io.BufferedReader(fs.open_input_file(name))
    return open(path.removeprefix("file://"), "rb")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[tuple]:
        try:
            with opened(partition.path) as raw, gzip.GzipFile(fileobj=raw) if partition.path.endswith(".gz") else raw as f:
                for headers, body in _records(f):
                    url = headers.get("warc-target-uri", "")
                    if headers.get("warc-type") != "metadata" or not url:
                        continue
                    links = _links(body)
                    if links is not None:
                        yield partition.path, url, links, None
        except (OSError, EOFError, ValueError, http.client.HTTPException) as e:  # a truncated or unreadable file is reported, not hidden
            yield partition.path, None, None, f"{type(e).__name__}: {e}"


class WatSource(DataSource):
    """format 'wat': option 'paths' is a JSON list of files. A file that breaks off gives a row with ``error``."""

    @classmethod
    def name(cls) -> str:
        return "wat"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options.get("paths", "[]")))


def read_wat(spark: SparkSession, paths: list[str]):
    spark.dataSource.register(WatSource)
    return spark.read.format("wat").option("paths", json.dumps(paths)).load()
