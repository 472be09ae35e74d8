"""Typed changes between consecutive full snapshots (problem 7).

Method: a store keeps each snapshot as one state per key, range-partitioned and sorted
by key, all snapshots with the same range bounds. Two snapshots are compared by a
two-pointer merge per range: a task streams the two sorted files of its range block by
block, advances the one that is behind, compares the states of equal keys and emits
typed changes. Writing a snapshot is one exchange; comparing two stored ones is none.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkprism.runtime import staging_path

#: Keys that the range bounds are taken from: a bounded sample, so bounds differ between corpora but no result does.
BOUND_SAMPLE = 20_000
#: Rows of a block in the merge.
BLOCK = 65_536
Block = tuple[np.ndarray, np.ndarray]


def state_mark(columns: list[str]) -> Column:
    """16 bytes that are equal if and only if all columns are (null equals null); a hash, so to 1 in 2**128 a pair."""
    parts = []
    for c in columns:
        text = F.col(c).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.substring(F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256)), 1, 16)


def _numbers(c: pa.Array) -> np.ndarray:
    return c.to_numpy(zero_copy_only=False) if pa.types.is_integer(c.type) else np.array([*c.to_pylist(), None], dtype=object)[:-1]


def _placed(batches: Iterator[pa.RecordBatch], bounds: list, order: list[str]) -> Iterator[pa.RecordBatch]:
    """Of each batch the latest row per snapshot and key, with its range: a key delivered often travels once a batch."""
    for b in batches:
        if not b.num_rows:
            continue
        by = ["_seq", "_key", *order]
        b = b.take(pc.sort_indices(b.select(by), sort_keys=[(c, "ascending") for c in by], null_placement="at_start"))
        seq, key = b.column("_seq").to_numpy(), _numbers(b.column("_key"))
        last = np.r_[(seq[1:] != seq[:-1]) | (key[1:] != key[:-1]), True]
        b, key = b.filter(pa.array(last)), key[last]
        ranges = np.searchsorted(bounds, key, side="right") if key.dtype != object else [bisect.bisect_right(bounds, k) for k in key]
        yield b.append_column("_range", pa.array(ranges, pa.int32()))


def blocks(path: str | None) -> Iterator[Block]:
    """(keys, marks) of a sorted file in blocks; of rows with one key the last stays, also across blocks."""
    if path is None:
        return
    fs, name = pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    held: Block | None = None
    with fs.open_input_file(name) as f:
        for b in pq.ParquetFile(f).iter_batches(BLOCK, columns=["_key", "_mark"]):
            keys, marks = _numbers(b.column(0)), np.array([*b.column(1).to_pylist(), None], dtype=object)[:-1]
            if held is not None:
                keys, marks = np.concatenate([held[0], keys]), np.concatenate([held[1], marks])
            last = np.r_[keys[1:] != keys[:-1], False].astype(bool)
            if last.any():
                yield keys[last], marks[last]
            held = keys[-1:], marks[-1:]
    if held is not None:
        yield held


def merged(before: Iterator[Block], after: Iterator[Block]) -> Iterator[tuple[str, np.ndarray]]:
    """(change, keys) of two sorted runs; each step consumes both up to the smaller of their blocks' last keys."""
    a, b = next(before, None), next(after, None)
    while a is not None or b is not None:
        if b is None:
            yield "removed", a[0]
            a = next(before, None)
            continue
        if a is None:
            yield "added", b[0]
            b = next(after, None)
            continue
        upto = min(a[0][-1], b[0][-1])
        i, j = np.searchsorted(a[0], upto, side="right"), np.searchsorted(b[0], upto, side="right")
        (ka, ma), (kb, mb) = (x[:i] for x in a), (x[:j] for x in b)
        at = np.searchsorted(kb, ka)
        both = at < len(kb)
        both[both] = kb[at[both]] == ka[both]
        fresh = np.ones(len(kb), dtype=bool)
        fresh[at[both]] = False
        yield "removed", ka[~both]
        yield "added", kb[fresh]
        yield "changed", ka[both][ma[both] != mb[at[both]]]
        a = tuple(x[i:] for x in a) if i < len(a[0]) else next(before, None)
        b = tuple(x[j:] for x in b) if j < len(b[0]) else next(after, None)


@dataclass
class SnapshotStore:
    """Snapshots under ``path``, a folder that all executors reach; ``bounds`` are the upper keys of all ranges but the last."""

    spark: SparkSession
    path: str
    bounds: list

    @classmethod
    def create(cls, keys: DataFrame, path: str, ranges: int) -> SnapshotStore:
        """A new store; its bounds cut a bounded sample of the distinct keys of the one-column ``keys`` into equal parts."""
        c = F.col(keys.columns[0])
        total = keys.count()
        share = min(1.0, 0.9 * BOUND_SAMPLE / max(1, total))
        some = keys.where(c.isNotNull() & (F.pmod(F.xxhash64(c), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))).distinct().limit(BOUND_SAMPLE)
        sample = sorted(r[0] for r in some.collect())
        bounds = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []
        store = cls(keys.sparkSession, path.rstrip("/"), bounds)
        store.spark.createDataFrame([(b,) for b in bounds], T.StructType([T.StructField("bound", keys.schema[0].dataType)])).coalesce(1).write.parquet(f"{store.path}/bounds")
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SnapshotStore:
        return cls(spark, path.rstrip("/"), sorted(r[0] for r in spark.read.parquet(f"{path.rstrip('/')}/bounds").collect()))

    def write(self, df: DataFrame, seq: Column, key: str, order: list[str], columns: list[str]) -> None:
        """Add the states of one or several snapshots, numbered by ``seq``; rows with a null number or key are no records.

        The state of a key is its row with the largest ``order``, null being smallest.
        """
        given = [f"_o{i}" for i in range(len(order))]
        rows = df.select(seq.cast("int").alias("_seq"), F.col(key).alias("_key"), *[F.col(o).alias(g) for o, g in zip(order, given)], state_mark(columns).alias("_mark"))
        rows = rows.where(F.col("_seq").isNotNull() & F.col("_key").isNotNull())
        bounds = self.bounds if not bounds_are_numbers(rows) else np.array(self.bounds, dtype=np.int64)
        schema = T.StructType([*rows.schema.fields, T.StructField("_range", T.IntegerType())])
        placed = rows.mapInArrow(lambda batches: _placed(batches, bounds, given), schema)
        ranged = placed.repartitionById(len(self.bounds) + 1, F.col("_range")).sortWithinPartitions("_seq", "_range", "_key", *given)
        ranged.select("_seq", "_range", "_key", "_mark").write.mode("append").partitionBy("_seq", "_range").option("compression", "zstd").parquet(f"{self.path}/states")

    def files(self) -> dict[tuple[int, int], str]:
        """The file of each snapshot and range; a range without states has none."""
        out = {}
        for f in self.spark.read.schema("_key string").parquet(f"{self.path}/states").inputFiles():
            seq, part = f.split("/_seq=")[1].split("/")[:2]
            if out.setdefault((int(seq), int(part.removeprefix("_range="))), f) != f:
                raise ValueError(f"snapshot {seq} was written twice")
        return out

    def changes(self, pairs: list[tuple[int, int, object]], snapshot: T.StructField, key: T.StructField) -> DataFrame:
        """(snapshot, key, change_kind) between the snapshots of each (earlier, later, name) pair, ``name`` being reported."""
        files = self.files()
        work = [(name, b, a) for x, y, name in pairs for r in range(len(self.bounds) + 1) if (b := files.get((x, r))) or files.get((y, r)) for a in [files.get((y, r))]]
        schema = T.StructType([snapshot, T.StructField(key.name, key.dataType), T.StructField("change_kind", T.StringType())])
        if not work:
            return self.spark.createDataFrame([], schema)
        shared = self.spark.sparkContext.broadcast(work)  # two file names a range and pair

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    name, before, after = shared.value[i]
                    for kind, keys in merged(blocks(before), blocks(after)):
                        if len(keys):
                            yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys)), pa.array(keys.tolist()), pa.array([kind] * len(keys))], names=schema.names)

        return self.spark.range(0, len(work), 1, len(work)).mapInArrow(run, schema)


def bounds_are_numbers(rows: DataFrame) -> bool:
    return isinstance(rows.schema["_key"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def snapshot_changes(
    df: DataFrame, runs: DataFrame, snapshot: str, key: str, order: list[str], columns: list[str], partitions: int | None = None
) -> DataFrame:
    """(snapshot, key, change_kind) for each two consecutive snapshots of ``runs``.

    ``runs`` gives each snapshot's name and ``seq``, the order of delivery; it is one
    row per snapshot, so its size is the number of deliveries. ``added``: only in the
    later; ``removed``: only in the earlier; ``changed``: in both, a compared column
    differs (null equals null). The first snapshot adds nothing. Rows with a null key
    or a snapshot not in ``runs`` are no records. Empty input gives no rows. The key
    is of an integer, string, date or decimal type. The store is a staged one; keep a
    ``SnapshotStore`` where deliveries arrive one by one.
    """
    spark = df.sparkSession
    names = {r[0]: int(r[1]) for r in runs.select(snapshot, "seq").where(F.col(snapshot).isNotNull()).collect()}
    schema = T.StructType([T.StructField(snapshot, df.schema[snapshot].dataType), T.StructField(key, df.schema[key].dataType), T.StructField("change_kind", T.StringType())])
    if not names:
        return spark.createDataFrame([], schema)
    kept = df.where(F.col(key).isNotNull() & F.col(snapshot).isin(list(names)))
    ranges = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    store = SnapshotStore.create(kept.select(key), staging_path(spark, "snapshots"), ranges)
    seq_of = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    store.write(kept, seq_of[F.col(snapshot)], key, order, columns)
    row = sorted((s, n) for n, s in names.items())
    return store.changes([(x, y, n) for (x, _), (y, n) in zip(row, row[1:])], schema[0], schema[1])
