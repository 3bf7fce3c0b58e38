"""Quality rules by cross-document line frequency, in built-in functions only.

Lines are normalised and hashed; for each host the distinct documents with a line are counted, lines above a limit are
removed, and documents that lose most of their words are rejected. Counts within a text (duplicate lines, repeated
3-word windows) are worked out inside its row. Texts are read once and never shuffled: what is known of each is written,
and line hashes are counted and looked up from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line in more documents of its host than this many of every thousand, and than these few, is boilerplate.
MAX_LINE_PERMILLE = 20
MAX_LINE_DOCS = 5
#: A document must keep at least this part of its words.
MIN_KEPT_PERCENT = 50
#: Boilerplate lines (of all hosts) that are broadcast at most; more are joined with salt.
MAX_BROADCAST = 500_000
SALTS = 32

_SPACES = " \t\n\x0b\f\r"


def words_of(text):
    """Maximal runs of characters other than \\x20 and \\x09-\\x0D."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _line_key(line):
    """The normalised line: lower case, digits as 0, white space folded and trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(line), "123456789", "000000000"), r"[\x20\x09-\x0D]+", " "))


def _worded_lines(text):
    return F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, _SPACES, "")) > 0)


def repeated_words(words):
    """Words lying in 3-word windows that occur twice or more, first occurrences included.

    Windows are compared by 64-bit hash: one sort finds the hashes that repeat; only texts that have some are sorted again with
    positions, where a window repeats if a neighbour in the order has its hash.
    """
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)))

    def count(hashes):
        places = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(sorted_places):
            size = F.size(sorted_places)

            def same(a, b):
                return F.coalesce(F.get(sorted_places, a)["h"] == F.get(sorted_places, b)["h"], F.lit(False))

            repeats = F.filter(F.transform(sorted_places, lambda p, k: F.when(same(k, k - 1) | same(k, k + 1), p["i"])), lambda i: i.isNotNull())
            return F.array_sort(repeats)

        def covered(at):
            gaps = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, g: acc + g)

        return _let(_let(places, starts), covered)

    def check(hashes):
        distinct = F.size(F.array_distinct(hashes))
        return F.when(distinct == F.size(hashes), F.lit(0).cast("long")).otherwise(count(hashes))

    return F.when(n < 3, F.lit(0).cast("long")).otherwise(_let(windows, check))


def _let(value, use):
    """Computes a column once and uses it several times within one expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parsed(docs: DataFrame) -> DataFrame:
    """What is known of each row (doc_id, host, text): the base counts, two hashes of the text, and of its lines (hash, words)."""
    text = F.col("text")
    of_words = _let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    of_lines = _let(
        _worded_lines(text),
        lambda x: F.struct(
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.transform(x, lambda y: F.struct(F.xxhash64(_line_key(y)).alias("line"), F.size(words_of(y)).alias("words"))).alias("lines"),
        ),
    )
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.when(F.col("host").isNull(), "n").otherwise(F.concat(F.lit("s"), "host")).alias("host"),
        F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), of_words.alias("w"), of_lines.alias("l"),
        (F.length("text") - F.regexp_count("text", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    failed = (F.col("w.n_words") < MIN_WORDS) | (100 * F.col("w.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("w.n_words"))
    return rows.select("row", "doc_id", "host", "t1", "t2", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", failed.alias("base_failed"), "l.lines")


def frequent_lines(rows: DataFrame) -> DataFrame:
    """(host, line) that more than the limit of the host's distinct documents hold."""
    documents = rows.select("host", "t1", "t2", F.col("lines.line").alias("lines")).dropDuplicates(["host", "t1", "t2"])
    per_line = documents.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line").agg(F.count("*").alias("docs"))
    per_host = rows.select("host", "t1", "t2").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    limit = F.greatest(F.lit(MAX_LINE_DOCS), F.floor(F.col("host_docs") * MAX_LINE_PERMILLE / 1000))
    return per_line.filter(F.col("docs") > MAX_LINE_DOCS).join(per_host, "host").filter(F.col("docs") > limit).select("host", "line")


def line_quality(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words, kept.

    kept is false if base_failed, or if frequent lines hold more than half of the words. A null text has no words and fails; a
    null host is a host of its own. Documents of a host are told apart by their text: rows that repeat a text, under whatever
    doc_id, are one document for the counts of lines, and each gets a result row. A null doc_id is returned as null. Other
    columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = keep(parsed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), text.alias("text"))), "lines")
    frequent = keep(frequent_lines(rows), "frequent").select(F.col("host").alias("of_host"), F.col("line").alias("of_line"))
    lines = rows.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.line", "x.words")
    same = (F.col("line") == F.col("of_line")) & (F.col("host") == F.col("of_host"))
    if frequent.count() <= MAX_BROADCAST:
        hits = lines.join(F.broadcast(frequent), same)
    else:
        salted = frequent.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = lines.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS))).join(salted, same & (F.col("salt") == F.col("of_salt")))
    removed = hits.groupBy(F.col("row").alias("of_row")).agg(F.sum("words").cast("long").alias("n_removed_words"))
    out = rows.drop("lines").join(removed, F.col("row") == F.col("of_row"), "left")
    gone = F.coalesce("n_removed_words", F.lit(0).cast("long"))
    kept = ~F.col("base_failed") & (100 * (F.col("n_words") - gone) >= MIN_KEPT_PERCENT * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", gone.alias("n_removed_words"), kept.alias("kept"))


#: The same in DuckDB SQL, by lines and windows themselves instead of their hashes.
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, host, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n >= 2),
rw AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
       FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d),
wl AS (SELECT doc_id, host, line,
              len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words,
              trim(regexp_replace(translate(lower(line), '123456789', '000000000'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS k
       FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dl AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM wl GROUP BY doc_id),
kl AS (SELECT doc_id, host, k, sum(words) AS words FROM wl GROUP BY ALL),
hd AS (SELECT host, count(DISTINCT text) AS host_docs FROM d GROUP BY host),
fl AS (SELECT kl.host, k FROM kl JOIN d USING (doc_id) JOIN hd ON kl.host IS NOT DISTINCT FROM hd.host GROUP BY kl.host, k, host_docs
       HAVING count(DISTINCT d.text) > greatest({MAX_LINE_DOCS}, host_docs * {MAX_LINE_PERMILLE} // 1000)),
rm AS (SELECT doc_id, kl.host, sum(words) AS n_removed_words
       FROM kl JOIN fl ON kl.k = fl.k AND kl.host IS NOT DISTINCT FROM fl.host GROUP BY ALL),
b AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(n_removed_words, 0) AS BIGINT) AS n_removed_words
      FROM w LEFT JOIN dl USING (doc_id) LEFT JOIN rw USING (doc_id) LEFT JOIN rm USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
       n_removed_words,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
         AND 100 * (n_words - n_removed_words) >= {MIN_KEPT_PERCENT} * n_words AS kept
FROM b
"""
