"""Sharding by extendible hashing: a directory over hash-prefix bits whose oversized buckets split on another bit.

Bytes are counted by hash prefix in Spark, at first as deep as the total asks for, then a few bits at a time and only below
prefixes that are still too large: what reaches the driver is in proportion to the directory, which has a leaf for about
each LIMIT_BYTES of text. Sums are carried up the prefix tree level by level. The leaves tile the hash space; a document's
shard is found by binary search.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, keep

LIMIT_BYTES = 64 << 20
#: Bits by which an oversized bucket is looked into at a time; a count has at most 2**STEP rows for each.
STEP = 4
MAX_DEPTH = 60
#: Oversized buckets that are broadcast at most; beyond it the same join shuffles.
MAX_BROADCAST = 1_000_000


def _key():
    """The upper 64 bits of the id's MD5, as a signed number; a null id goes by its text."""
    name = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.concat(F.lit("t"), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 16), 16, -10).cast("long")


def _sums(prefix: np.ndarray, size: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The level above: bytes of each prefix less its last bit, and whether all its rows share one hash."""
    up = prefix >> U64(1)
    first = np.flatnonzero(np.concatenate(([True], up[1:] != up[:-1]))) if len(up) else np.zeros(0, int)
    alone = np.diff(np.append(first, len(up))) == 1
    return up[first], np.add.reduceat(size, first) if len(up) else size, alone & single[first]


def _depth(total: int, limit: int) -> int:
    """Bits after which a bucket holds about the limit."""
    return min(MAX_DEPTH, max(1, (total // max(1, limit)).bit_length() + 1))


def build_directory(sizes: DataFrame, limit: int = LIMIT_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaves in hash order as arrays (first hash, depth, bytes), from rows (h, bytes). A bucket whose rows share one hash is never split."""
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    pending, depth, to = np.zeros(1, U64), 0, _depth(total, limit)
    leaves: list[tuple[np.ndarray, np.ndarray, int]] = []
    while len(pending):
        rows = sizes
        if depth:
            at = sizes.sparkSession.createDataFrame(pd.DataFrame({"p": pending.astype(np.int64)}))
            if len(pending) <= MAX_BROADCAST:
                at = F.broadcast(at)
            rows = rows.join(at, F.shiftrightunsigned("h", 64 - depth) == F.col("p"), "left_semi")
        prefix = F.shiftrightunsigned("h", 64 - to)
        counted = rows.groupBy(prefix.alias("p")).agg(F.sum("bytes").alias("bytes"), (F.min("h") == F.max("h")).alias("single")).toPandas().sort_values("p")
        levels = {to: (counted["p"].to_numpy(np.int64).astype(U64), counted["bytes"].to_numpy(np.int64), counted["single"].to_numpy(bool))}
        for d in range(to - 1, depth - 1, -1):
            levels[d] = _sums(*levels[d + 1])
        for d in range(depth, to + 1):
            known, size, single = levels[d]
            at = np.searchsorted(known, pending)
            there = at < len(known)
            there[there] = known[at[there]] == pending[there]
            held = np.zeros(len(pending), np.int64)
            held[there] = size[at[there]]
            alone = ~there
            alone[there] = single[at[there]]
            done = (held <= limit) | alone | (d == MAX_DEPTH)
            leaves.append((pending[done], held[done], d))
            pending = pending[~done]
            if d < to:
                pending = np.stack([pending << U64(1), (pending << U64(1)) | U64(1)], axis=1).ravel()
        depth, to = to, min(to + STEP, MAX_DEPTH)
    first = np.concatenate([p << U64(64 - d) if d else p for p, _, d in leaves])
    depths, held = np.concatenate([np.full(len(p), d, np.int32) for p, _, d in leaves]), np.concatenate([n for _, n, _ in leaves])
    order = np.argsort(first)
    return first[order], depths[order], held[order]


def shards(docs: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """The documents with __ql_bytes, __ql_shard, __ql_depth and __ql_shard_bytes.

    Bytes are those of the text in UTF-8, null has none. A shard exceeds the limit only if all its rows share one key hash (one
    document, or repeated rows of it). A null doc_id is spread by its text. An empty table has one empty shard.
    """
    rows = docs.withColumns({"__ql_bytes": F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long"), "__ql_hash": _key()})
    starts, depths, total = build_directory(keep(rows.select(F.col("__ql_hash").alias("h"), F.col("__ql_bytes").alias("bytes")), "sizes"), limit)
    directory = docs.sparkSession.sparkContext.broadcast((starts, depths, total))  # 20 bytes for each LIMIT_BYTES of text

    @F.pandas_udf("shard int, depth int, bytes long")
    def look(h: pd.Series) -> pd.DataFrame:
        starts, depths, total = directory.value
        at = np.searchsorted(starts, h.to_numpy(np.int64).view(np.uint64), side="right") - 1
        return pd.DataFrame({"shard": at.astype(np.int32), "depth": depths[at], "bytes": total[at]})

    found = rows.withColumn("__ql_at", look("__ql_hash"))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], "__ql_bytes", F.col("__ql_at.shard").alias("__ql_shard"), F.col("__ql_at.depth").alias("__ql_depth"), F.col("__ql_at.bytes").alias("__ql_shard_bytes"))


def shard_digest(docs: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """Per document: doc_id, n_bytes, shard, depth, shard_bytes."""
    out = shards(docs.select("doc_id", "text"), limit)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__ql_bytes").alias("n_bytes"), F.col("__ql_shard").alias("shard"), F.col("__ql_depth").alias("depth"), F.col("__ql_shard_bytes").alias("shard_bytes"))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT_BYTES) -> None:
    """Writes one folder of Parquet for each shard."""
    out = shards(docs, limit)
    out.drop("__ql_bytes", "__ql_depth", "__ql_shard_bytes").repartition("__ql_shard").write.partitionBy("__ql_shard").parquet(path)


def oracle_sql(limit: int = LIMIT_BYTES) -> str:
    """The same in DuckDB SQL: buckets are split one bit at a time."""
    oversized = f"bytes > {limit} AND hashes > 1 AND depth < {MAX_DEPTH}"
    return f"""
WITH RECURSIVE s AS MATERIALIZED (
  SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 't' || coalesce(text, ''))), 1, 16) AS UBIGINT) AS h,
         CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes FROM documents),
node AS (
  SELECT CAST(0 AS UBIGINT) AS lo, 0 AS depth, CAST(coalesce(sum(n_bytes), 0) AS BIGINT) AS bytes, count(DISTINCT h) AS hashes FROM s
  UNION ALL
  SELECT c.lo, c.depth, CAST(coalesce(sum(n_bytes), 0) AS BIGINT), count(DISTINCT h)
  FROM (SELECT lo + b * CAST(pow(2.0, 63 - depth) AS UBIGINT) AS lo, depth + 1 AS depth
        FROM node, (VALUES (CAST(0 AS UBIGINT)), (CAST(1 AS UBIGINT))) v(b) WHERE {oversized}) c
  LEFT JOIN s ON s.h >= c.lo AND s.h - c.lo < CAST(pow(2.0, 64 - c.depth) AS UBIGINT)
  GROUP BY c.lo, c.depth),
leaf AS (SELECT lo, depth, bytes, CAST(row_number() OVER (ORDER BY lo) - 1 AS INT) AS shard FROM node WHERE NOT ({oversized}))
SELECT doc_id, n_bytes, shard, depth, bytes AS shard_bytes FROM s ASOF JOIN leaf ON s.h >= leaf.lo
"""
