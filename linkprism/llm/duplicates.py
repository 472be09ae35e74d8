"""Copies hidden by formatting differences (problem 6).

Method: recursive radix partitioning on canonical bytes. Every row gets a canonical
string; equal strings are merged within each input task first, so a hot group shrinks
to one entry a task. Buckets are the strings' leading characters; a bucket too large
for one task is split by twice as many characters, again and again until each fits or
holds one string only. Each bucket is then counted in a path-compressed trie with
terminal counters.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkprism.llm.common import is_text
from linkprism.runtime import staged

#: White space and punctuation, as they are ignored (ASCII signs count as punctuation).
IGNORED = r"[\s\p{Z}\p{P}\x{85}\x{1c}-\x{1f}$+<=>^`|~]+"
#: Canonical characters that one bucket may hold.
FIT_CHARS = 32_000_000
#: Characters of the first buckets; each split doubles them.
FIRST_DEPTH = 2
#: Prefixes of split buckets are broadcast up to this number (8 bytes each), beyond it joined by a shuffle.
BROADCAST_PREFIXES = 1_000_000
#: Groups of this share of all rows are handed out by broadcast; there are at most 1 / share of them.
HOT_SHARE = 0.001
_SEP = "\x01"


def fold_case(c: Column) -> Column:
    """Case folding; ß equals SS and final sigma equals sigma."""
    return F.replace(F.replace(F.lower(F.upper(c)), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def canonical_text(c: Column) -> Column:
    return F.regexp_replace(fold_case(c), IGNORED, "")


def _decoded(c: Column) -> Column:
    """Percent and plus decoding; broken escapes stay as they are."""
    return F.try_url_decode(F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25"))


def canonical_url(c: Column) -> Column:
    """Decoded, case-folded address with sorted parameters, their values without white space and punctuation."""
    split = F.instr(c, "?")
    base = F.when(split > 0, F.substr(c, F.lit(1), split - 1)).otherwise(c)
    query = F.when(split > 0, F.substr(c, split + 1)).otherwise(F.lit(""))
    base = fold_case(_decoded(F.replace(base, F.lit("+"), F.lit("%2B"))))

    def param(p: Column) -> Column:
        eq = F.instr(p, "=")
        key = F.when(eq > 0, F.substr(p, F.lit(1), eq - 1)).otherwise(p)
        value = F.when(eq > 0, F.substr(p, eq + 1)).otherwise(F.lit(""))
        return F.concat(fold_case(_decoded(key)), F.lit("="), canonical_text(_decoded(value)))

    params = F.array_sort(F.transform(F.split(query, "&"), param))
    return F.concat(F.coalesce(base, F.lit("")), F.lit("?"), F.coalesce(F.array_join(params, "&"), F.lit("")))


def canonical_rows(df: DataFrame, row_id: str, text: str, url: str, scope: str) -> DataFrame:
    """(row_id, canon); rows without text are left out, null addresses and scopes count as empty."""
    canon = F.concat_ws(_SEP, canonical_text(F.col(text)), F.coalesce(canonical_url(F.col(url)), F.lit("")), F.coalesce(F.col(scope), F.lit("")))
    return df.where(is_text(F.col(text))).select(F.col(row_id).alias("row_id"), canon.alias("canon"))


class Trie:
    """Path-compressed trie over bytes; a terminal holds [copies, first row, digest]."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: list = [None, {}]  # terminal, first byte -> [label, node]

    def add(self, key: bytes, n: int, first: int, digest: bytes) -> None:
        node = self.root
        while key:
            edge = node[1].get(key[0])
            if edge is None:
                node[1][key[0]] = [key, leaf := [None, {}]]
                node = leaf
                break
            label, child = edge
            if key.startswith(label):
                key, node = key[len(label) :], child
                continue
            k = len(os.path.commonprefix((label, key)))
            mid = [None, {label[k]: [label[k:], child]}]
            node[1][key[0]] = [label[:k], mid]
            key, node = key[k:], mid
        if node[0] is None:
            node[0] = [n, first, digest]
        else:
            node[0][0] += n
            node[0][1] = min(node[0][1], first)

    def terminals(self) -> Iterator[list]:
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node[0] is not None:
                yield node[0]
            stack.extend(e[1] for e in node[1].values())


_COMBINED = "canon string, digest binary, ids array<long>"
_GROUPS = "digest binary, n_copies long, first_row_id long"


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge equal strings of one task, a bounded number of them at a time; every row id stays."""
    held: dict[str, list[int]] = {}

    def flush() -> pa.RecordBatch:
        digests = [hashlib.sha256(k.encode()).digest() for k in held]
        out = pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array(digests, pa.binary()), pa.array(list(held.values()), pa.list_(pa.int64()))], names=["canon", "digest", "ids"]
        )
        held.clear()
        return out

    size = 0
    for b in batches:
        for row, canon in zip(b.column("row_id").to_pylist(), b.column("canon").to_pylist()):
            ids = held.get(canon)
            if ids is None:
                held[canon] = [row]
                size += len(canon)
            else:
                ids.append(row)
            size += 8
        if size > FIT_CHARS:
            yield flush()
            size = 0
    if held:
        yield flush()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One trie a bucket; the rows of a bucket stand together."""
    bucket, trie = None, Trie()

    def out(t: Trie) -> pa.RecordBatch:
        rows = list(t.terminals())
        return pa.RecordBatch.from_arrays(
            [pa.array([r[2] for r in rows], pa.binary()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())],
            names=["digest", "n_copies", "first_row_id"],
        )

    held = 0
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("bucket", "canon", "digest", "n", "first_row_id")]
        for k, canon, digest, n, first in zip(*cols):
            if k != bucket:
                if held > 20_000:
                    yield out(trie)
                    trie, held = Trie(), 0
                bucket = k
            trie.add(canon.encode(), n, first, digest)
            held += 1
    if held:
        yield out(trie)


def _prefix(depth: int) -> Column:
    return F.xxhash64(F.substring("canon", 1, depth))


def split_prefixes(combined: DataFrame, fit: int = FIT_CHARS) -> list[tuple[int, DataFrame, int]]:
    """(depth, hashed prefixes, their number) of the buckets that were split, level by level.

    A bucket is split while its strings hold more than ``fit`` characters and differ;
    so the recursion ends where a bucket fits or holds equal strings only, at whatever
    depth that is. The prefixes stay a distributed table. Prefixes with one hash count
    as one bucket, which at most splits it early.
    """
    levels: list[tuple[int, DataFrame, int]] = []
    live, depth = combined, FIRST_DEPTH
    while True:
        whole = F.xxhash64("canon")
        sizes = live.groupBy(_prefix(depth).alias("_h")).agg(F.sum(F.length("canon")).alias("s"), F.min(whole).alias("a"), F.max(whole).alias("z"))
        over = staged(sizes.where((F.col("s") > fit) & (F.col("a") != F.col("z"))).select("_h"), "split")
        n = over.count()
        if n == 0:
            return levels
        levels.append((depth, over, n))
        live = combined.withColumn("_h", _prefix(depth)).join(_sized(over, n), "_h", "left_semi").drop("_h")
        depth *= 2


def _sized(prefixes: DataFrame, n: int) -> DataFrame:
    return F.broadcast(prefixes) if n <= BROADCAST_PREFIXES else prefixes


def bucketed(combined: DataFrame, fit: int = FIT_CHARS) -> DataFrame:
    """``combined`` with ``bucket``: the hash of the shortest prefix, of a length in the doubling row, that was not split."""
    levels = split_prefixes(combined, fit)
    out, open_ = combined, F.lit(True)
    bucket = None
    for depth, over, n in levels:
        name = f"_s{depth}"
        out = out.withColumn("_h", _prefix(depth)).join(_sized(over.withColumn(name, F.lit(True)), n), "_h", "left").drop("_h")
        done = open_ & F.col(name).isNull()
        bucket = F.when(done, _prefix(depth)) if bucket is None else bucket.when(done, _prefix(depth))
        open_ = open_ & F.col(name).isNotNull()
    last = _prefix(levels[-1][0] * 2 if levels else FIRST_DEPTH)
    bucket = last if bucket is None else bucket.otherwise(last)
    return out.withColumn("bucket", bucket).drop(*[f"_s{depth}" for depth, *_ in levels])


def copy_groups(combined: DataFrame, fit: int = FIT_CHARS) -> DataFrame:
    """(digest, n_copies, first_row_id) of each distinct canonical string of (canon, digest, ids)."""
    merged = combined.select("canon", "digest", F.size("ids").cast("long").alias("n"), F.array_min("ids").alias("first_row_id"))
    return bucketed(merged, fit).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count, _GROUPS)


def copies(df: DataFrame, row_id: str = "row_id", text: str = "primary_prompt_text", url: str = "target_url", scope: str = "crawl", fit: int = FIT_CHARS) -> tuple[DataFrame, DataFrame]:
    """(groups, members): one row per distinct record, and one per row that is not its group's first.

    groups: first_row_id (the smallest), n_copies. members: first_row_id, row_id. Rows
    without text belong to no group; all other columns are ignored. A row id must be
    unique. Members of groups with at least ``HOT_SHARE`` of all rows are found by a
    broadcast of those groups, so no task gathers a hot group.
    """
    combined = staged(canonical_rows(df, row_id, text, url, scope).mapInArrow(_combine, _COMBINED), "combined")
    groups = staged(copy_groups(combined, fit), "groups")
    total = groups.agg(F.sum("n_copies")).first()[0] or 0
    least = max(10_000, int(total * HOT_SHARE))
    many = groups.where("n_copies > 1").select("digest", "n_copies", "first_row_id")
    hot = F.broadcast(many.where(F.col("n_copies") >= least))  # at most 1 / HOT_SHARE rows
    cold = many.where(F.col("n_copies") < least)
    ids = combined.select("digest", F.explode("ids").alias("row_id"))
    found = ids.join(hot, "digest").unionByName(ids.join(hot, "digest", "left_anti").join(cold, "digest"))
    members = found.where(F.col("row_id") != F.col("first_row_id")).select("first_row_id", "row_id")
    return groups.select("first_row_id", "n_copies"), members
