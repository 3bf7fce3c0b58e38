"""Language by compression: a text has the language whose dictionary compresses it best.

Per language a zstandard raw-content dictionary is filled with stretches of training texts. Every text, whole, is
encoded in chunks with each dictionary; the smallest total wins, and a narrow margin marks the result as rejected.
"""

from __future__ import annotations

import math

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the training sample: stretches for each language, and their characters.
STRETCHES = 64
STRETCH_CHARS = 2000
LEVEL = 3
CHUNK = 4096
#: Least lead over the second language as a part of the text's size.
MARGIN = 0.01


def _letters(text):
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " "))


def held_out(doc_id):
    """crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(train: DataFrame) -> dict[str, bytes]:
    """Dictionaries by language, from the doc with the smallest id hash in each of STRETCHES hash classes."""
    h = F.xxhash64("doc_id")
    picked = train.filter("lang is not null and text is not null and doc_id is not null").groupBy("lang", F.pmod(h, F.lit(STRETCHES)).alias("k")).agg(F.min(h).alias("h")).select("lang", "h")
    start = F.pmod(h, F.greatest(F.length("text") - STRETCH_CHARS, F.lit(1))) + 1
    text = _letters(F.substring(F.col("text"), start.cast("int"), F.lit(STRETCH_CHARS)))
    drawn = train.withColumn("h", h).join(F.broadcast(picked), ["lang", "h"]).select("lang", "h", text.alias("t"))
    rows = drawn.groupBy("lang", "h").agg(F.min("t").alias("t")).collect()  # at most STRETCHES a language, however often an id is repeated
    out: dict[str, list[str]] = {}
    for r in sorted(rows):
        out.setdefault(r["lang"], []).append(r["t"])
    return {k: " ".join(v).encode() for k, v in out.items() if any(v)}


def _predictor(dictionaries: dict[str, bytes]):
    names = sorted(dictionaries)

    def run(batches):
        coders = []
        for name in names:
            d = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            coders.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        for batch in batches:
            langs, scores, rejected = [], [], []
            for text in batch.column(2):
                raw = (text.as_py() or "").encode()
                if not raw or not names:
                    langs.append("und")
                    scores.append(0.0)
                    rejected.append(True)
                    continue
                chunks = [raw[k : k + CHUNK] for k in range(0, len(raw), CHUNK)]
                sizes = [sum(len(c.compress(x)) for x in chunks) for c in coders]
                order = sorted(range(len(names)), key=lambda k: (sizes[k], names[k]))
                best = sizes[order[0]]
                weights = [math.exp(min(0.0, -100.0 * (s - best) / len(raw))) for s in sizes]
                langs.append(names[order[0]])
                scores.append(1.0 / sum(weights))
                rejected.append(len(order) > 1 and (sizes[order[1]] - best) / len(raw) < MARGIN)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (0 to 1), rejected (the margin is narrow).

    A null text or one without letters (marks alone are none) is `und` with score 0, as is any text when nothing was learned. Ties go to the first
    language by name. Repeated rows give repeated results; a null doc_id counts as not held out. Other columns are not read.
    """
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    spoken = F.when(F.regexp_like(text, F.lit(r"\p{L}")), _letters(text))
    rows = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), spoken.alias("text"))
    return rows.mapInArrow(_predictor(dictionaries), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def language_id(docs: DataFrame) -> DataFrame:
    """Learns from the texts and languages of documents that are not held out, predicts all from text alone."""
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return predict(docs, learn(train.filter(~held_out(F.col("doc_id")))))
