"""Benchmark decontamination by spaced seeds.

Fixed masks select some positions of a window of words and ignore the others, so a window still matches where an
ignored word was substituted. Hashes of all windows of the benchmark are looked up in all windows of the documents;
around every hit the item and the document are laid side by side and the stretch with most matches among those with few
substitutions decides.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, doc_words, mix, text_buffers

# Fixed masks: 1 takes a word, 0 ignores it. Together they hit every stretch that `enough` and PENALTY admit for items of 7 words
# or more, wherever its substitutions are (the tests go through all of them); `short_masks` does the same for shorter items.
MASKS = ("1111", "11101", "1010011")
SHORT = 7
MIN_MATCHED = 13
ITEM_SHARE = 0.8
PENALTY = 2
#: An item of one word is part of no text in particular; it is not searched.
MIN_ITEM = 2
#: Bytes of benchmark text held by a task at a time; a larger benchmark is searched in several passes over the documents.
BYTES_AT_ONCE = 8 << 20
#: Upper bits of a seed by which most windows of a document are told to be in no item before the sorted seeds are searched.
COARSE_BITS = 20

_STEP = mix(np.arange(1, 65, dtype=U64) * U64(0xA24BAED4963EE407)) | U64(1)


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """A hash for every window of the mask's length."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, U64(len(mask)))
    for k, taken in enumerate(mask):
        if taken == "1":
            out = out + hashes[k : k + n] * _STEP[k % 64]
    return mix(out)


def short_masks(n: int) -> list[str]:
    """Masks over a whole item of n words, fewer than 7: all words, or all but one inside."""
    return ["1" * n] + ["1" * k + "0" + "1" * (n - k - 1) for k in range(1, n - 1) if enough(n - 1, n) and n - 1 >= PENALTY]


def words_only(text):
    """Lower case, runs of anything but letters and digits become one space: case and punctuation do not hide a copy."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " ")


def build_index(items: list[tuple[int, str]]):
    """Sorted seed hashes with item and position, the items' word hashes, and the masks in use (short items get their own)."""
    data, offs = text_buffers(pa.array([t or "" for _, t in items], pa.string()))
    words = [h[a : a + n] for _, counts, h, _, _ in doc_words(data, offs) for a, n in zip(np.concatenate(([0], np.cumsum(counts)[:-1])), counts, strict=True)]
    masks = list(MASKS) + [m for n in sorted({len(w) for w in words if MIN_ITEM <= len(w) < SHORT}) for m in short_masks(n)]
    parts = []
    for k, w in enumerate(words):
        if len(w) < MIN_ITEM:
            continue
        for m, mask in enumerate(masks):
            if m < len(MASKS) or len(mask) == len(w):
                s = seeds(w, mask)
                parts.append((s, np.full(len(s), k), np.arange(len(s))))
    if not parts:
        return None
    s, k, p = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(s, kind="stable")
    return s[order], k[order], p[order], words, [i for i, _ in items], masks


def best_stretch(same: np.ndarray) -> tuple[int, int, int]:
    """Start, end and matches of the stretch with the most matches among those with at least PENALTY matches for each substitution.

    It starts and ends with a match; the first of equal ones counts.
    """
    total = np.concatenate(([0], np.cumsum(np.where(same, 1, -PENALTY))))
    matches = np.concatenate(([0], np.cumsum(same)))
    start = np.searchsorted(-np.minimum.accumulate(total), -total)  # the first place that is no higher than the end
    end = int(np.argmax(matches - matches[start]))
    matched = int(matches[end] - matches[start[end]])
    begin = int(start[end])
    return begin + int(np.argmax(same[begin:end])) if matched else begin, end, matched


def enough(matched: int, item_words: int) -> bool:
    return matched >= min(MIN_MATCHED, max(1, math.ceil(ITEM_SHARE * item_words)))


def overlaps(index, texts: pa.Array):
    """Yields (row, item id, doc start, item start, words, matched words) of the best stretch for each text and item that overlap."""
    hashes, item, place, words, ids, masks = index
    coarse = np.zeros(1 << COARSE_BITS, bool)
    coarse[hashes >> U64(64 - COARSE_BITS)] = True
    for row, counts, h, _, _ in doc_words(*text_buffers(texts), lower=False):
        bounds = np.concatenate(([0], np.cumsum(counts)))
        parts = []
        for mask in masks:
            s = seeds(h, mask)
            if not len(s):
                continue
            at = np.flatnonzero(coarse[s >> U64(64 - COARSE_BITS)])
            lo = np.searchsorted(hashes, s[at])
            n = np.searchsorted(hashes, s[at], side="right") - lo
            at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
            doc = np.searchsorted(bounds, at, side="right") - 1
            inside = at + len(mask) <= bounds[doc + 1]
            at, lo, n, doc = at[inside], lo[inside], n[inside], doc[inside]
            k = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            parts.append(np.column_stack((np.repeat(doc, n), item[k], np.repeat(at - bounds[doc], n) - place[k])))
        pairs = np.unique(np.concatenate(parts), axis=0).tolist() if parts else []
        best = {}
        for d, k, shift in pairs:
            doc, w = h[bounds[d] : bounds[d + 1]], words[k]
            a = max(0, -shift)
            b = min(len(w), len(doc) - shift)
            start, end, matched = best_stretch(doc[a + shift : b + shift] == w[a:b])
            if enough(matched, len(w)) and matched > best.get((d, k), (0,))[-1]:
                best[d, k] = (a + shift + start, a + start, end - start, matched)
        for (d, k), found in best.items():
            yield row + d, ids[k], *found


def _searcher(index):
    def run(batches):
        names = ["doc_id", "item_id", "doc_start", "item_start", "n_words", "n_matched"]
        for batch in batches:
            found = list(overlaps(index.value, batch.column(1)))
            rows = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([rows, *(pa.array([f[k] for f in found], pa.int64()) for k in range(1, 6))], names)

    return run


def _clear_of(index):
    @F.arrow_udf("boolean")
    def clear(texts: pa.Array) -> pa.Array:
        out = np.ones(len(texts), bool)
        out[[f[0] for f in overlaps(index.value, texts)]] = False
        return pa.array(out)

    return clear


def _indexes(benchmark: DataFrame):
    """Yields the broadcast index of one bounded slice of the benchmark, the stated query set, at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words_only(F.col("text").cast("string")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-size // BYTES_AT_ONCE))
    for k in range(passes):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).collect()
        index = build_index(sorted({(r["item_id"], r["text"] or "") for r in part}, key=str))
        if index is not None:
            yield benchmark.sparkSession.sparkContext.broadcast(index)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item that overlap: doc_id, item_id, doc_start, item_start, n_words, n_matched (in words).

    A document overlaps an item where a stretch with at most a third of substitutions matches MIN_MATCHED words, or
    ITEM_SHARE of a shorter item of two words or more. The stretch with the most matches is given. Null or empty texts and items match nothing; repeated rows give
    repeated results; a null id is returned as null; no other column is read. Either table may be empty.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_only(F.col("text").cast("string")).alias("text"))
    schema = "doc_id long, item_id long, doc_start long, item_start long, n_words long, n_matched long"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in _indexes(benchmark):
        out = out.unionByName(rows.mapInArrow(_searcher(index), schema))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows whose text overlaps no benchmark item; all columns stay. Rows are searched where they are read: nothing is shuffled."""
    for index in _indexes(benchmark):
        docs = docs.filter(_clear_of(index)(words_only(F.col("text").cast("string"))))
    return docs
