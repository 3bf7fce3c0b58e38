"""Repeated passages by content-defined chunking.

A gear rolling hash over the last 16 bytes cuts texts where its upper bits are zero, so cuts depend on nearby bytes alone and
an insertion moves no cut but its own. Chunks are deduplicated by a 64-bit digest; a run of chunks that all occur elsewhere,
with at least MIN_WORDS words, is a repeated passage. It stays in the first document (the smallest doc_id).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import _BYTE, _SPACE, PIECE, U64, _power, keep, mix, text_buffers

WINDOW = 16
#: Upper bits of the gear hash that are zero at a cut: chunks have 2**CUT_BITS bytes on average.
CUT_BITS = 4
#: Words that begin in a run. A run lacks up to some 10 words of the passage at its ends, before the first and after the last cut.
MIN_WORDS = 26
#: A chunk of more bytes (one without a cut, such as one character over and over) is cut here whatever the hash says.
LARGEST = (1 << 24) - 1
#: Bytes of text whose chunks one shard holds, about; the number of shards follows the input.
SHARD_BYTES = 8 << 20
FLUSH = 250_000
#: A digest with so many chunks in one flush, in several documents, is hot: they do not meet in one task. Its first place is worked out from
#: two chunks of such a flush and whatever others hold, and a second pass over the texts finds all its chunks where they are.
HOT = 64
#: Hot digests whose first places are broadcast at most; more are joined with salt.
MAX_BROADCAST = 500_000
SALTS = 32

_GEAR = (mix(np.arange(301, 557, dtype=U64) * U64(0x9E3779B97F4A7C15)) >> U64(32)).astype(np.uint32)


def gear(raw: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: the sum of gear[byte] shifted by its distance, built by doubling the window."""
    h = _GEAR[raw]
    w = 1
    while w < WINDOW:
        if len(h) > w:
            more = h[:-w] << np.uint32(w)
            h = h.copy()
            h[w:] += more
        w *= 2
    return h << np.uint32(32 - WINDOW)


def cuts(raw: np.ndarray) -> np.ndarray:
    """Ends of the chunks of one text. Of neighbouring cuts the first counts; a cut never parts a UTF-8 character."""
    parts = []
    for a in range(0, len(raw), PIECE):
        back = min(a, WINDOW)
        h = gear(raw[a - back : a + PIECE])[back - (1 if a else 0) :]
        zero = (h >> np.uint32(32 - CUT_BITS)) == 0
        first = zero.copy()
        first[1:] &= ~zero[:-1]
        if a:
            first = first[1:]
        parts.append(np.flatnonzero(first) + a + 1)
    at = np.concatenate([*parts, np.arange(LARGEST - 3, len(raw), LARGEST - 3)]).astype(np.int64)
    for _ in range(3):
        inside = at < len(raw)
        at[inside] += (raw[at[inside]] & 0xC0) == 0x80
    at = np.unique(np.append(at[at < len(raw)], len(raw)))
    return at if len(raw) else at[:0]


def digests(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit digest for each chunk, in groups of about PIECE bytes."""
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    out, k = np.zeros(len(ends), U64), 0
    while k < len(ends):
        j = max(k + 1, int(np.searchsorted(ends, starts[k] + PIECE, side="right")))
        a, sizes = int(starts[k]), (ends[k:j] - starts[k:j]).astype(np.int64)
        begin = starts[k:j] - a
        place = np.arange(int(ends[j - 1]) - a) - np.repeat(begin, sizes)
        values = _BYTE[raw[a : int(ends[j - 1])]] * _power(int(sizes.max()))[place]
        out[k:j] = mix(np.add.reduceat(values, begin) + sizes.astype(U64))
        k = j
    return out


def _flushes(batches, most: int):
    """Arrays (digest, doc, start, size, words that begin in it) of about `most` chunks, sorted by digest, doc and start, each once."""
    held, n = [], 0

    def flush():
        d, i, s, z, w = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((s, i, d))
        d, i, s, z, w = d[order], i[order], s[order], z[order], w[order]
        once = np.concatenate(([True], (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (s[1:] != s[:-1])))
        return d[once], i[once], s[once], z[once], w[once]

    for batch in batches:
        data, offs = text_buffers(batch.column(1))
        for k, doc in enumerate(batch.column(0).to_pylist()):
            raw = data[offs[k] : offs[k + 1]]
            if doc is None or not len(raw):
                continue
            ends = cuts(raw).astype(np.int64)
            sizes = np.diff(ends, prepend=0)
            solid = ~_SPACE[raw]
            solid[1:] &= _SPACE[raw[:-1]]
            words = np.add.reduceat(solid.astype(np.int64), ends - sizes)
            held.append((digests(raw, ends), np.full(len(ends), doc, np.int64), ends - sizes, sizes, words))
            n += len(ends)
            if n >= most:
                yield flush()
                held, n = [], 0
    if n:
        yield flush()


def _hot(d: np.ndarray, i: np.ndarray, least: int) -> np.ndarray:
    """Which of the sorted chunks have a hot digest."""
    first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
    size = np.diff(np.append(first, len(d)))
    several = i[first] != i[first + size - 1]
    return np.repeat((size >= least) & several, size)


def _chunk_blobs(bits: int, least: int, most: int):
    """Chunks by shard. Of a hot digest only its first chunk and one of another document go there, marked by size 0."""
    schema = pa.schema([("shard", pa.int32()), ("digests", pa.binary()), ("docs", pa.binary()), ("starts", pa.binary()), ("sizes", pa.binary())])

    def run(batches):
        for d, i, s, z, w in _flushes(batches, most):
            hot = _hot(d, i, least)
            z = np.where(hot, 0, w << 24 | z)
            edge = np.concatenate(([True], d[1:] != d[:-1]))
            ends = hot & (edge | np.concatenate((edge[1:], [True])))
            taken = ~hot | ends
            d, i, s, z = d[taken], i[taken], s[taken], z[taken]
            shard = (d >> U64(64 - bits)).astype(np.int32)
            edges = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)]
            rows = [(int(shard[a]), planes(d[a:b]), planes(i[a:b].view(U64)), planes(s[a:b].view(U64)), planes(z[a:b].view(U64))) for a, b in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _hot_chunks(leads, most: int):
    """All chunks with one of the (broadcast, sorted) digests, or all chunks if there are too many of these to broadcast."""

    def run(batches):
        for d, i, s, z, w in _flushes(batches, most):
            hot = slice(None)
            if leads is not None:
                known = leads.value
                hot = known[np.minimum(np.searchsorted(known, d), len(known) - 1)] == d
            yield pa.RecordBatch.from_arrays([pa.array(x[hot]) for x in (d.view(np.int64), i, s, z, w)], ["digest", "doc_id", "start", "size", "words"])

    return run


def planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte in planes, so that equal upper bytes lie together and compress; first the number of planes that are not all zero."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unplanes(column) -> np.ndarray:
    blobs = [x.as_py() for x in column]
    out = np.zeros((sum((len(x) - 1) // x[0] for x in blobs), 8), np.uint8)
    at = 0
    for x in blobs:
        n = (len(x) - 1) // x[0]
        out[at : at + n, : x[0]] = np.frombuffer(x, np.uint8, offset=1).reshape(x[0], n).T
        at += n
    return out.view("<u8").ravel()


def _repeats(across: bool):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        d, i, s, z = unplanes(table["digests"]), unplanes(table["docs"]).view(np.int64), unplanes(table["starts"]).view(np.int64), unplanes(table["sizes"]).view(np.int64)
        order = np.lexsort((z, s, i, d))
        d, i, s, z = d[order], i[order], s[order], z[order]
        new = np.concatenate(([True], (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (s[1:] != s[:-1])))  # rows with equal doc_id and text are one document
        d, i, s, z = d[new], i[new], s[new], z[new]
        first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        size = np.diff(np.append(first, len(d)))
        again = (i[first] != i[first + size - 1]) if across else size > 1
        group = np.repeat(np.arange(len(first)), size)
        hot = np.bincount(group, z == 0, len(first)) > 0
        lead = first[group]
        many = (again & ~hot)[group]
        leads = first[hot]
        none = np.zeros(len(leads), np.int64)
        parts = ((d.view(np.int64)[many], d.view(np.int64)[leads]), (i[many], none), (s[many], none), (z[many] & LARGEST, none), (z[many] >> 24, none), (i[lead][many], i[leads]), (s[lead][many], s[leads]))
        names = ("digest", "doc_id", "start", "size", "words", "first_doc", "first_start")
        return pa.table({n: np.concatenate(x) for n, x in zip(names, parts, strict=True)})

    return run


def shard_bits(docs: DataFrame) -> int:
    """Bits of a digest that choose its shard, from the bytes of all texts."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return min(24, max(4, int(size // SHARD_BYTES).bit_length()))


def repeated_chunks(docs: DataFrame, across: bool = True) -> DataFrame:
    """Every occurrence of a chunk that occurs in more than one document (or, unless `across`, at more than one place): doc_id, start,
    size (bytes), words (that begin in it), first_doc, is_first. Repeated rows may give an occurrence again."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bits = shard_bits(rows)
    blobs = rows.mapInArrow(_chunk_blobs(bits, HOT, FLUSH), "shard int, digests binary, docs binary, starts binary, sizes binary")
    found = keep(blobs.groupBy("shard").applyInArrow(_repeats(across), "digest long, doc_id long, start long, size long, words long, first_doc long, first_start long"), "chunks")
    leads = found.filter("size = 0").select(F.col("digest").alias("of"), "first_doc", "first_start")
    n = leads.count()
    small = n <= MAX_BROADCAST
    known = docs.sparkSession.sparkContext.broadcast(np.sort(leads.select("of").toArrow()["of"].to_numpy().view(U64))) if n and small else None
    hot = rows.mapInArrow(_hot_chunks(known, FLUSH), "digest long, doc_id long, start long, size long, words long")
    if not n:
        hot = found.limit(0)
    elif small:
        hot = hot.join(F.broadcast(leads), F.col("digest") == F.col("of"))
    else:
        leads = leads.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hot = hot.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).join(leads, (F.col("digest") == F.col("of")) & (F.col("salt") == F.col("of_salt")))
    every = found.filter("size > 0").select("doc_id", "start", "size", "words", "first_doc", "first_start").unionByName(hot.select("doc_id", "start", "size", "words", "first_doc", "first_start"))
    return every.select("doc_id", "start", "size", "words", "first_doc", ((F.col("doc_id") == F.col("first_doc")) & (F.col("start") == F.col("first_start"))).alias("is_first"))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row per passage that several documents hold: doc_id, start, end, n_chunks, n_words, removed_bytes, first_doc_id (of its first chunk).

    Places are bytes of the UTF-8 text. removed_bytes counts the chunks that an earlier document (a smaller doc_id) has; 0 means that this is the
    passage the others repeat. What repeats within one document alone is no passage. Null and empty texts have none. Rows with equal doc_id and
    text are the same document; a row with a null doc_id takes no part. Other columns are not read.
    """
    return passages(repeated_chunks(docs))


def passages(chunks: DataFrame) -> DataFrame:
    """Runs of adjoining repeated chunks with at least MIN_WORDS words. A chunk that repeated rows give again counts once."""
    order = Window.partitionBy("doc_id").orderBy("start", "size")
    again = (F.lag("start").over(order) == F.col("start")) & (F.lag("size").over(order) == F.col("size"))
    chunks = chunks.withColumn("again", again).filter("again is null or not again")
    ends = F.max(F.col("start") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = chunks.withColumn("new", F.coalesce(F.col("start") > ends, F.lit(True)).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = runs.groupBy("doc_id", "run").agg(
        F.min("start").alias("start"),
        F.max(F.col("start") + F.col("size")).alias("end"),
        F.count("*").alias("n_chunks"),
        F.sum("words").alias("n_words"),
        F.sum(F.when(F.col("first_doc") != F.col("doc_id"), F.col("size")).otherwise(0)).alias("removed_bytes"),
        F.min_by("first_doc", "start").alias("first_doc_id"),
    )
    return found.filter(F.col("n_words") >= MIN_WORDS).select("doc_id", "start", "end", "n_chunks", "n_words", "removed_bytes", "first_doc_id")


@F.arrow_udf(StringType())
def _cut_texts(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, gone in zip(texts, spans, strict=True):
        raw, at, parts = (text.as_py() or "").encode(), 0, []
        for span in gone.as_py() or ():
            parts.append(raw[at : span["a"]])
            at = max(at, span["b"])
        out.append(b"".join([*parts, raw[at:]]).decode())
    return pa.array(out, pa.string())


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents with all their columns; texts lose the chunks of repeated passages that an earlier document has."""
    chunks = keep(repeated_chunks(docs), "repeats")
    spans = passages(chunks).filter("removed_bytes > 0").select("doc_id", "start", "end")
    gone = chunks.filter("first_doc <> doc_id").select("doc_id", F.col("start").alias("a"), (F.col("start") + F.col("size")).alias("b"))
    gone = gone.join(spans, "doc_id").filter("a >= start and b <= end").groupBy(F.col("doc_id").alias("__ql_doc")).agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("__ql_spans"))
    out = docs.join(gone, F.col("doc_id") == F.col("__ql_doc"), "left")
    return out.withColumn("text", F.when(F.col("__ql_spans").isNull(), F.col("text")).otherwise(_cut_texts(F.col("text").cast("string"), "__ql_spans"))).drop("__ql_doc", "__ql_spans")
