"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is cut into blocks of documents by a hash, about BLOCK_WORDS words each. Targets say how many blocks of a source
are taken: some full passes and a part of one more, in a permuted order. These exact quotas are split among output shards
down a binary tree: at each node the left child's blocks by source are one multivariate-hypergeometric draw. Every shard
walks its own path from the root, so no task holds the tree. The shards then take consecutive, so disjoint, stretches of
each source's permuted blocks and are shuffled locally.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

#: Words of a block and of an output shard, about; their numbers follow the input.
BLOCK_WORDS = 1 << 16
LEAST_BLOCKS = 1024
SHARD_WORDS = 1 << 24
LEAST_SHARDS = 16
SEED = 20240229
MAX_REPEATS = 3
#: Rows of the block plan that are broadcast at most; a larger plan is joined by a shuffle.
MAX_PLAN_ROWS = 200_000
#: Sources that are broadcast at most. The driver holds a number for each source, however many: their targets depend on all of them.
MAX_SOURCES = 100_000


def targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """Words wanted from each source: weights 1, 2, 3, 1, ... by code point (null last) share all words; a source stops
    at MAX_REPEATS times its size and the excess is shared again by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    total, out, free = float(sum(sizes.values())), {}, list(order)
    while free:
        left = total - sum(out.values())
        share = sum(weight[s] for s in free)
        above = [s for s in free if left * weight[s] / share > MAX_REPEATS * sizes[s]]
        if not above:
            return out | {s: left * weight[s] / share for s in free}
        out |= {s: float(MAX_REPEATS * sizes[s]) for s in above}
        free = [s for s in free if s not in out]
    return out


def draw(counts: np.ndarray, take: int, seed: int, node: int) -> np.ndarray:
    """How many of `take` blocks come from each source: one multivariate-hypergeometric draw, the same for a node wherever it is made."""
    rng = np.random.Generator(np.random.PCG64([seed, node]))
    return rng.multivariate_hypergeometric(counts, take, method="marginals") if len(counts) else counts


def shard_path(quotas: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For one shard: the number of its blocks of each source, and how many of the source's blocks go to shards before it."""
    counts, before, lo, hi, node = np.asarray(quotas, np.int64), np.zeros(len(quotas), np.int64), 0, shards, 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = draw(counts, int(counts.sum()) * (mid - lo) // (hi - lo), seed, node)
        if shard < mid:
            counts, hi, node = left, mid, 2 * node
        else:
            counts, before, lo, node = counts - left, before + left, mid, 2 * node + 1
    return counts, before


def split_quotas(quotas: np.ndarray, shards: int, seed: int | None = None) -> np.ndarray:
    """An exact (shards x sources) table of block numbers: columns sum to the quotas, rows differ by at most one block."""
    return np.stack([shard_path(quotas, shards, k, SEED if seed is None else seed)[0] for k in range(shards)])


def _cuts(spark, names: list[str], quotas: np.ndarray, shards: int, seed: int) -> DataFrame:
    """(source, shard, lo): where the stretch of each shard begins in each source's order of blocks."""
    shared = spark.sparkContext.broadcast((names, quotas))  # a number for each source

    def run(batches):
        names, quotas = shared.value
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                counts, before = shard_path(quotas, shards, shard, seed)
                some = np.flatnonzero(counts)
                columns = [pa.array([names[k] for k in some], pa.string()), pa.array(np.full(len(some), shard, np.int32)), pa.array(before[some])]
                yield pa.RecordBatch.from_arrays(columns, ["__ql_source", "shard", "lo"])

    return spark.range(shards).mapInArrow(run, "__ql_source string, shard int, lo long")


def word_count(text):
    """Maximal runs of characters other than \\x20 and \\x09-\\x0D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(source, doc_id, text):
    """The source's key and the hash that gives a document its block."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source)), F.xxhash64(F.coalesce(doc_id.cast("long"), F.xxhash64(text)), F.lit(SEED))


def _blocks(words):
    """Blocks of a source, from its words: a power of two."""
    return F.greatest(F.lit(LEAST_BLOCKS), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(words, F.lit(1)) / BLOCK_WORDS)))).cast("long")


def sizes_of(docs: DataFrame) -> DataFrame:
    """doc_id, size (words), source key and hash of every row, written: texts are read for it once."""
    text = F.col("text").cast("string")
    key, h = _key(F.col("source").cast("string"), F.col("doc_id"), text)
    return keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_count(text).alias("size"), key.alias("__ql_source"), h.alias("__ql_h")), "sizes")


def plan(sizes: DataFrame, seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Per source: words, target, number of blocks. Per block that is taken: places, an array of (pass, shard, order in the shard)."""
    spark, seed = sizes.sparkSession, SEED if seed is None else seed
    sized = {r[0]: r[1] for r in sizes.groupBy("__ql_source").agg(F.sum("size")).collect()}  # a row for each source
    names = {k: None if k == "n" else k[1:] for k in sized}
    goal = targets({names[k]: n for k, n in sized.items()})
    goals = spark.createDataFrame([(k, n, float(goal[names[k]])) for k, n in sized.items()], "__ql_source string, source_size long, target double")
    goals = goals.withColumn("__ql_blocks", _blocks(F.col("source_size")))
    goals = F.broadcast(goals) if len(sized) <= MAX_SOURCES else goals
    block = F.pmod("__ql_h", "__ql_blocks").alias("__ql_block")
    blocks = keep(sizes.join(goals, "__ql_source").groupBy("__ql_source", block, "source_size", "target").agg(F.sum("size").alias("words")), "blocks")
    order = Window.partitionBy("__ql_source").orderBy(F.xxhash64("__ql_source", "__ql_block", F.lit(seed + 1)), "__ql_block")
    ranked = blocks.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    ranked = ranked.withColumns({"rank": F.row_number().over(order) - 1, "before": F.sum("words").over(order) - F.col("words"), "rest": F.col("target") - F.col("passes") * F.col("source_size")})
    # the last, partial pass takes blocks in permuted order while that brings the sum nearer to what is wanted;
    # then the one block whose taking or leaving comes nearest to the remaining gap is turned over
    ranked = ranked.withColumn("in_rest", (F.col("words") > 0) & (F.col("rest") > 0) & (F.col("before") + F.col("words") / 2 < F.col("rest")))
    ranked = ranked.withColumn("gap", F.col("rest") - F.sum(F.when(F.col("in_rest"), F.col("words")).otherwise(0)).over(Window.partitionBy("__ql_source")))
    misses = F.when((F.col("words") > 0) & ((F.col("gap") > 0) != F.col("in_rest")), F.abs(F.abs("gap") - F.col("words")))
    ranked = ranked.withColumn("miss", misses)
    nearest = F.row_number().over(Window.partitionBy("__ql_source").orderBy(F.asc_nulls_last("miss"), "rank"))
    turned = (nearest == 1) & F.coalesce(F.col("miss") < F.abs("gap"), F.lit(False))
    ranked = ranked.withColumn("turned", turned).withColumn("copies", F.col("passes") + F.when(F.col("in_rest") != F.col("turned"), 1).otherwise(0))
    ranked = ranked.withColumn("copies", F.when(F.col("words") > 0, F.least("copies", F.lit(MAX_REPEATS))).otherwise(0))
    copies = keep(ranked.select("__ql_source", "__ql_block", F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies").cast("int")))).alias("pass")), "copies")
    numbers = copies.groupBy("__ql_source").agg(F.count("*").alias("q")).orderBy("__ql_source").collect()  # a row for each source
    shards = max(LEAST_SHARDS, 1 << (sum(sized.values()) // SHARD_WORDS).bit_length())
    cuts = _cuts(spark, [r["__ql_source"] for r in numbers], np.array([r["q"] for r in numbers], np.int64), shards, seed)
    again = Window.partitionBy("__ql_source").orderBy("pass", F.xxhash64("__ql_source", "__ql_block", "pass", F.lit(seed + 2)), "__ql_block")
    placed = copies.withColumn("place", F.row_number().over(again) - 1)
    # a shard's stretch goes from its beginning to the next: the beginnings are put among the places and carried forward
    both = placed.unionByName(cuts.select("__ql_source", F.col("lo").alias("place"), "shard"), allowMissingColumns=True)
    forward = Window.partitionBy("__ql_source").orderBy("place", F.col("shard").isNull(), "shard").rowsBetween(Window.unboundedPreceding, 0)
    dealt = both.withColumn("shard", F.last("shard", True).over(forward)).filter("pass is not null")
    in_shard = F.xxhash64("__ql_source", "__ql_block", "pass", F.lit(seed + 3))
    places = dealt.groupBy("__ql_source", "__ql_block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard", in_shard.alias("order")))).alias("places"))
    return goals, keep(places, "plan")


def planned(rows: DataFrame, goals: DataFrame, places: DataFrame) -> DataFrame:
    """Rows (with __ql_source and __ql_h) with their source's figures and their block's places (null if it is not taken)."""
    rows = rows.join(goals, "__ql_source").withColumn("__ql_block", F.pmod("__ql_h", "__ql_blocks"))
    return rows.join(F.broadcast(places) if places.count() <= MAX_PLAN_ROWS else places, ["__ql_source", "__ql_block"], "left")


def mix_digest(docs: DataFrame, seed: int | None = None) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's), taken (words the mix takes, repeats counted), places.

    places lists pass:shard:order for each time the mix takes the document: the shard of the splitting tree and the place by which
    the shard is shuffled. The mix has as many words as all documents. A null source is a source of its own, the last; a null or
    empty text has no words and is not taken; repeated rows are taken alike; a null doc_id is spread by its text. An empty
    table stays empty.
    """
    sizes = sizes_of(docs)
    out = planned(sizes, *plan(sizes, seed))
    times = F.when(F.col("size") > 0, F.coalesce(F.size("places"), F.lit(0))).otherwise(0)
    order = F.xxhash64("__ql_h", "__ql_source")
    said = F.when(times > 0, F.array_join(F.transform("places", lambda p: F.concat_ws(":", p["pass"].cast("string"), p["shard"].cast("string"), F.xxhash64(p["order"], order).cast("string"))), ",")).otherwise("")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.greatest(times, F.lit(0))).cast("long").alias("taken"), said.alias("places"))


def mix(docs: DataFrame, shard_columns: bool = False, seed: int | None = None) -> DataFrame:
    """The mix itself: a row for each time a document is taken, with its own columns. Rows of a shard lie together, shuffled: each
    shard is one partition, sorted by a hash. With shard_columns also __ql_shard and __ql_order."""
    names = docs.columns
    alike = docs.toDF(*[f"__ql_c{k}" for k in range(len(names))])
    column = {n.lower(): F.col(f"__ql_c{k}") for k, n in enumerate(names) if n.lower() in ("doc_id", "text", "source")}
    goals, places = plan(sizes_of(docs), seed)
    key, h = _key(column["source"].cast("string"), column["doc_id"], column["text"].cast("string"))
    out = planned(alike.withColumns({"__ql_source": key, "__ql_h": h, "__ql_size": word_count(column["text"].cast("string"))}).filter("__ql_size > 0"), goals, places)
    out = out.withColumn("__ql_place", F.explode("places"))
    out = out.withColumns({"__ql_shard": F.col("__ql_place.shard"), "__ql_order": F.xxhash64("__ql_place.order", F.xxhash64("__ql_h", "__ql_source"))})
    out = out.repartition("__ql_shard").sortWithinPartitions("__ql_shard", "__ql_order", "__ql_h")
    return out.select(*[F.col(f"__ql_c{k}").alias(n) for k, n in enumerate(names)], *(["__ql_shard", "__ql_order"] if shard_columns else []))


def write_mix(docs: DataFrame, path: str) -> None:
    """Writes the mix as one folder of Parquet for each shard, rows in shuffled order."""
    mix(docs, True).drop("__ql_order").write.partitionBy("__ql_shard").parquet(path)
