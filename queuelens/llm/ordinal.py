"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector over hashed text features, ordered thresholds between the
grades. Features are presence bits: words, their first and last bytes, and classes of a few ratios of the whole text.
Grades come from `labels`: quality (0, 1) and toxic (0, 1) give 2 good, 1 flawed one way, 0 flawed both ways.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, doc_words, mix, text_buffers

BITS = 18
#: Bound of the labelled sample the model is fitted on (documents, the first by hash of their id).
MAX_LABELLED = 12_000
MIN_DF = 5
#: A feature gets a weight if its documents' mean grade is so many standard errors away from the mean of all that, of all
#: features tested, this many would be by chance.
BY_CHANCE = 0.05
PREFIX = 5
STEPS = 400
RIDGE = 3e-5
#: A document stays if its tail probability P(grade >= GOOD) is at least this.
GOOD = 2
LEAST_TAIL = 0.7

_MASK = U64((1 << BITS) - 1)


def word_features(data: np.ndarray, offs: np.ndarray):
    """Of clean text: its words and their first PREFIX bytes. Yields (row, n rows, row of each feature, feature)."""
    for row, counts, h, starts, ends in doc_words(data, offs, lower=False):
        owner = np.repeat(np.arange(len(counts)), counts)
        raw = data[int(offs[row]) : int(offs[row + len(counts)])]
        prefix = np.full(len(h), U64(7))
        for k in range(PREFIX):
            inside = starts + k < ends
            prefix[inside] = prefix[inside] * U64(257) + raw[starts[inside] + k].astype(U64)
        yield row, len(counts), np.concatenate([owner, owner]), np.concatenate([h & _MASK, mix(prefix ^ U64(0xC2B2AE3D)) & _MASK]).astype(np.int64)


def shape_features(data: np.ndarray, offs: np.ndarray):
    """Of raw text: the last two bytes of words, and classes of the shares of distinct words, capitals and marks, and of length."""
    for row, counts, h, starts, ends in doc_words(data, offs):
        owner = np.repeat(np.arange(len(counts)), counts)
        base = int(offs[row])
        raw = data[base : int(offs[row + len(counts)])]
        n = np.maximum(counts, 1)
        one, two = raw[ends - 1].astype(U64), raw[np.maximum(ends - 2, starts)].astype(U64)
        ending = (mix(one * U64(256) + two + U64(1 << 20)) & _MASK).astype(np.int64)
        order = np.lexsort((h, owner))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        distinct = np.bincount(owner[order][fresh], minlength=len(counts))
        byte_of = np.repeat(np.arange(len(counts)), np.diff(offs[row : row + len(counts) + 1]))
        folded = raw | 32
        letters = np.bincount(byte_of[(folded >= 97) & (folded <= 122)], minlength=len(counts))
        upper = np.bincount(byte_of[(raw >= 65) & (raw <= 90)], minlength=len(counts))
        marks = np.bincount(byte_of[((raw >= 33) & (raw <= 47)) | ((raw >= 58) & (raw <= 64)) | ((raw >= 91) & (raw <= 96)) | ((raw >= 123) & (raw <= 126))], minlength=len(counts))
        ratios = [10 * distinct // n, 10 * upper // np.maximum(letters, 1), 10 * marks // np.maximum(letters + marks, 1), np.minimum(20, np.log2(n + 1)).astype(int)]
        extra = [(mix((np.asarray(r).astype(U64) + U64(1000 * (k + 1))) ^ U64(0x5BD1E995)) & _MASK).astype(np.int64) for k, r in enumerate(ratios)]
        rows = np.arange(len(counts))
        yield row, len(counts), np.concatenate([owner, *[rows] * len(extra)]), np.concatenate([ending, *extra])


def batch_features(text: pa.Array, clean: pa.Array):
    """Features of a batch of texts and their clean forms."""
    yield from shape_features(*text_buffers(text))
    yield from word_features(*text_buffers(clean))


def _clean():
    return F.regexp_replace(F.lower(F.col("text").cast("string")), r"[^\p{L}\p{M}\p{N}]+", " ")


def _texts() -> list:
    return [F.col("text").cast("string").alias("text"), _clean().alias("clean")]


def _extract(batches):
    for batch in batches:
        out: list = [[] for _ in range(len(batch))]
        for row, n, owner, feature in batch_features(batch.column(1), batch.column(2)):
            key = np.unique(owner * (1 << BITS) + feature)
            cuts = np.searchsorted(key, np.arange(n + 1) << BITS)
            for k in range(n):
                out[row + k].append((key[cuts[k] : cuts[k + 1]] & int(_MASK)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.unique(np.concatenate(x)) for x in out], pa.list_(pa.int32()))], ["grade", "x"])


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: list[np.ndarray], grades: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the mean log-likelihood. Thresholds stay ordered: gaps are exponentials. No thresholds if the grades are
    all one or no feature tells them apart."""
    top = int(grades.max()) if len(grades) else 0
    weights = np.zeros(1 << BITS)
    if not len(rows) or not top or grades.min() == top:
        return weights, np.zeros(0)
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate(rows)
    df = np.bincount(flat, minlength=1 << BITS)
    owner = np.repeat(np.arange(len(rows)), sizes)
    lean = np.bincount(flat, (grades - grades.mean())[owner], 1 << BITS) / (np.maximum(grades.std(), 1e-9) * np.sqrt(np.maximum(df, 1)))
    tested = df >= MIN_DF
    least = NormalDist().inv_cdf(1 - BY_CHANCE / 2 / max(1, int(tested.sum())))
    used = np.flatnonzero(tested & (np.abs(lean) >= least))
    if not len(used):
        return weights, np.zeros(0)  # nothing tells good from bad: no document is rejected
    column = np.full(1 << BITS, -1)
    column[used] = np.arange(len(used))
    at = column[flat]
    owner, at = owner[at >= 0], at[at >= 0]
    n, y = len(rows), grades.astype(int)
    share = np.array([((y <= k).sum() + 1) / (n + 2) for k in range(top)])
    first = np.log(share / (1 - share))
    theta = np.concatenate(([first[0]], np.log(np.maximum(np.diff(first), 1e-2))))
    w = np.zeros(len(used))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(theta), np.zeros_like(theta)]
    for step in range(1, steps + 1):
        cut = np.concatenate(([-np.inf], theta[0] + np.concatenate(([0.0], np.cumsum(np.exp(theta[1:])))), [np.inf]))
        z = np.bincount(owner, w[at], n)
        hi, lo = sigmoid(cut[y + 1] - z), np.where(y > 0, sigmoid(cut[y] - z), 0.0)
        hi = np.where(y == top, 1.0, hi)
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        gw = np.bincount(at, ((dhi - dlo) / n)[owner], len(used)) + RIDGE * w
        gcut = np.array([(-(dhi * (y == k)).sum() + (dlo * (y == k + 1)).sum()) / n for k in range(top)])
        gt = np.array([gcut.sum()] + [gcut[k:].sum() * np.exp(theta[k]) for k in range(1, top)])
        for value, grad, a, b, rate in ((w, gw, moments[0], moments[1], 0.1), (theta, gt, moments[2], moments[3], 0.05)):
            a *= 0.9
            a += 0.1 * grad
            b *= 0.99
            b += 0.01 * grad * grad
            value -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    weights[used] = w
    return weights, theta[0] + np.concatenate(([0.0], np.cumsum(np.exp(theta[1:]))))


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Fits on at most MAX_LABELLED labelled documents; labels with a null are not used. Of rows that repeat a doc_id one counts, the one
    whose text has the smallest hash, so the same tables give the same model."""
    grade = (F.col("quality") - F.col("toxic") + 1).cast("int")
    rated = labels.select(F.col("doc_id").cast("long").alias("of_doc"), grade.alias("grade")).filter("of_doc is not null and grade between 0 and 2")
    rated = rated.groupBy("of_doc").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("of_doc"), "of_doc").limit(MAX_LABELLED)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(rated), F.col("doc_id") == F.col("of_doc"))
    once = rows.groupBy("of_doc").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "grade")).alias("x")).select(F.col("x.grade").cast("long").alias("grade"), F.col("x.text").alias("text"))
    sample = once.select("grade", *_texts()).mapInArrow(_extract, "grade long, x array<int>").toArrow()
    x = sample["x"].combine_chunks()
    flat, offs = x.values.to_numpy(), x.offsets.to_numpy()
    texts = [flat[offs[k] : offs[k + 1]] for k in range(len(x))]
    grades = sample["grade"].to_numpy()
    order = sorted(range(len(texts)), key=lambda k: (grades[k], texts[k].tobytes()))
    return fit([texts[k] for k in order], grades[order])


def _score(model, text: pa.Array, clean: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Expected grade and tail probability of each text."""
    weights, cuts = model
    live, z = weights != 0, np.zeros(len(text))
    for row, n, owner, feature in batch_features(text, clean):
        hit = live[feature]
        key = np.unique(owner[hit] * (1 << BITS) + feature[hit])
        z[row : row + n] += np.bincount(key >> BITS, weights[key & int(_MASK)], n)
    if not len(cuts):
        return np.full(len(z), float(GOOD)), np.ones(len(z))
    tails = sigmoid(z[:, None] - cuts[None, :])
    return tails.sum(axis=1), tails[:, -1]


def _grader(model):
    def run(batches):
        for batch in batches:
            expected, tail = _score(model.value, batch.column(1), batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(expected), pa.array(tail), pa.array(tail >= LEAST_TAIL)], ["doc_id", "expected_grade", "tail", "kept"])

    return run


def grade(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """One row per document: doc_id, expected_grade (0 to 2), tail (P of the best grade), kept.

    Null and empty texts are graded by their few ratio features. Without usable labels every document has the best grade.
    Repeated rows give repeated results; a null doc_id is returned as null; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_texts())
    return rows.mapInArrow(_grader(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, expected_grade double, tail double, kept boolean")


def select_good(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The rows whose text the model keeps, all columns. Rows are graded where they are read: nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def good(text: pa.Array, clean: pa.Array) -> pa.Array:
        return pa.array(_score(shared.value, text, clean)[1] >= LEAST_TAIL)

    return docs.filter(good(F.col("text").cast("string"), _clean()))
