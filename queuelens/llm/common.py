"""What several operators of this subpackage share: the shared folder, written tables, and a vectorised
tokenizer that works on Arrow buffers (no Python string for a word is ever made)."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: Text is worked on in pieces of about this many bytes, so memory does not follow a batch's size.
PIECE = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset a local session gets a folder of its own; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="queuelens-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def keep(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: later stages survive the loss of any executor. The application's folder is deleted
    when it ends."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/queuelens/{spark.sparkContext.applicationId}"
    path = f"{folder}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _delete_at_end(spark, folder)
    return spark.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt over all cores where the table is read in fewer parts than there are cores, as one small file is; else as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _delete_at_end(spark: SparkSession, folder: str) -> None:
    if folder not in _MARKED:
        _MARKED.add(folder)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


_MARKED: set[str] = set()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offs


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (multiply, shift, xor)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = U64(0xD6E8FEB86659FD93)
_POWER = np.multiply.accumulate(np.full(4096, _BASE, U64))


def _power(n: int) -> np.ndarray:
    global _POWER
    if n > len(_POWER):
        _POWER = np.multiply.accumulate(np.full(2 * n, _BASE, U64))
    return _POWER


def _piece(raw: np.ndarray, breaks: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of one piece: hashes, starts, ends. A word never crosses one of the breaks."""
    solid = ~_SPACE[raw]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = breaks[(breaks > 0) & (breaks < len(raw))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return np.zeros(0, U64), starts, ends
    dense = raw[solid]
    if lower:
        dense = _LOWER[dense]
    lengths = ends - starts
    begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(len(dense)) - np.repeat(begin, lengths)
    values = _BYTE[dense] * _power(int(lengths.max()))[place]
    return mix(np.add.reduceat(values, begin) + lengths.astype(U64)), starts, ends


def doc_words(data: np.ndarray, offs: np.ndarray, lower: bool = True):
    """Yields (first row, word counts of the rows, 64-bit word hashes, starts, ends) for runs of rows.

    Words are maximal runs of bytes other than \\x20 and \\x09-\\x0D; `lower` folds A-Z. Starts and ends are
    bytes counted from the first row's start. A run of rows holds about PIECE bytes; a longer row comes alone,
    read in pieces that end between words.
    """
    row, rows = 0, len(offs) - 1
    while row < rows:
        end = row + 1
        if offs[end] - offs[row] < PIECE:
            end = max(end, int(np.searchsorted(offs, offs[row] + PIECE, side="right")) - 1)
            base = int(offs[row])
            hashes, starts, ends = _piece(data[base : int(offs[end])], offs[row : end + 1] - base, lower)
            counts = np.diff(np.searchsorted(starts, offs[row : end + 1] - base))
        else:
            base, stop, parts, at = int(offs[row]), int(offs[end]), [], int(offs[row])
            while at < stop:
                to = min(stop, at + PIECE)
                while to < stop and not _SPACE[data[to]]:  # a piece ends before a space
                    gap = np.flatnonzero(_SPACE[data[to : to + PIECE]])
                    to = to + int(gap[0]) if len(gap) else min(stop, to + PIECE)
                h, s, e = _piece(data[at:to], np.zeros(0, np.int64), lower)
                parts.append((h, s + (at - base), e + (at - base)))
                at = to
            hashes, starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
            counts = np.array([len(hashes)])
        yield row, counts, hashes, starts, ends
        row = end


_STEP = mix(np.arange(101, 133, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int = 5):
    """Yields (row, sorted distinct 64-bit shingle hashes) for every row; a shorter text is one shingle."""
    for row, counts, hashes, _, _ in doc_words(data, offs):
        bounds = np.concatenate(([0], np.cumsum(counts)))
        rolled = np.zeros(0, U64)
        if len(hashes) >= width:
            n = len(hashes) - width + 1
            rolled = np.zeros(n, U64)
            for k in range(width):
                rolled += hashes[k : k + n] * _STEP[k]
            rolled = mix(rolled)
        for i, n in enumerate(counts):
            a = bounds[i]
            if n >= width:
                s = np.sort(rolled[a : a + n - width + 1])
                if len(s) > 1:
                    s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif n:
                s = mix(np.array([(hashes[a : a + n] * _STEP[:n]).sum() + U64(n)], U64))
            else:
                s = np.zeros(0, U64)
            yield row + i, s
