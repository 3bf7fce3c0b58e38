"""Main text of web pages by nearest-URL page differencing.

Pages are ordered by host and URL path; every page is paired with the nearest page of its host that is not a copy of
it. The text lines (blocks) of both are aligned by longest common subsequence and shared lines are deleted. Page
structure decides first where it is explicit: lines inside an article element stay even when neighbours share them
(texts may quote the same passage), lines inside navigation, advert, form, comment and similar elements go even when
they are unique. Differencing decides the rest: every line of a page without an article element, and, anywhere, lines of
elements whose names only contain a structure word (`search-results`, `notice-period`): these go if a neighbour has them.
"""

from __future__ import annotations

import bisect
import hashlib
import html
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

#: Pages in a range at most, about, while MAX_DRAWS bounds suffice; there are at least as many ranges as shuffle partitions.
ROWS_A_BUCKET = 10_000
#: Keys drawn for the bounds of the ranges at most, and rows near the ranges' ends that are broadcast at most (8 a range; more are joined by a shuffle).
MAX_DRAWS = 1_000_000
MAX_BROADCAST = 200_000
#: Different line lists looked at on either side when the nearest are near copies; pages with equal lists are passed over, however many.
REACH = 3
#: A neighbour sharing this part of the characters is a copy, unless both pages have words of their own: it says nothing about boilerplate.
COPY_SHARE = 0.6
#: Lines of one page that the alignment holds bit masks of at a time: memory stays small for pages of any number of lines.
LCS_BLOCK = 8192
#: The part of a page's words that its lines must have beyond the other's lines to make them its own.
OWN_SHARE = 0.1

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: Attributes up to the bracket that ends their tag. Quotes open after an equals sign only and must close. Nothing is gone back over, and only
#: the last quote of a page can be looked for in vain, so the time is in proportion to the text.
_ATTRS = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+""")
_ATTR = re.compile(r"""([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# HTML element names and common class, id and role words.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style template noscript textarea title iframe svg canvas object math select".split())
_BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption".split())
_HARD = frozenset("head nav footer aside form menu dialog button fieldset".split())
_WORDS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments reply replies respond disqus share sharing social related recommended widget toolbar pagination pager login search form skip".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_BODY = frozenset(("articlebody", "main-content", "article-body", "article-content", "post-content", "post-body", "entry-content"))
#: Words that say nothing beside a structure word (`cookie-bar`), endings that are one even when written together (`usercomments`),
#: and parts of a page's main element that are not the article.
_FILL = frozenset("a an and area article articles author bar block body bottom box button buttons card cards close component container content count date feed field follow for frame global group header holder icon icons inner input item items label left link links list main message messages meta module my nav of open our outer page panel post posts prompt reader region right row section settings site slot space spot sticky stories strip tab tabs text the thread toggle top trail trigger unit us user users window wrap wrapper zone".split())
_ENDINGS = ("comment", "comments", "sidebar", "navbar", "cookiebar", "menu", "advert", "adverts", "breadcrumbs")
_OTHERS = frozenset("comment comments reply replies related sponsored".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_HIDDEN = re.compile(r"display\s*:\s*none")
_CLOSES_P = _BLOCKS - {"body", "html", "option", "legend", "summary", "caption"}

MAIN, OPEN, HARD = 0, 1, 2
#: Added to MAIN or OPEN: a structure word is only a part of the element's name (`search-results`), so neighbours decide.
SOFT = 4


def _kind(tag: str, attrs: str, inside: bool) -> tuple[bool, bool, bool]:
    """Whether an element is boilerplate, whether it may be, and whether it holds the article."""
    main = tag in ("article", "main")
    hard = tag in _HARD or (tag == "header" and not inside)
    if not attrs or attrs.isspace():
        return hard, False, main
    words, names, role, ids = set(), set(), "", set()
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            names.update(n.lower().strip("-_") for n in value.split())
            words.update(w.lower() for w in _PARTS.findall(value))
        elif name == "role":
            role = value.lower()
        elif name == "itemprop":
            ids.add(value.lower())
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDDEN.search(value)):
            hard = True
    main = main or role in ("main", "article") or bool((ids | names) & _BODY)
    hard = hard or role in _ROLES
    if tag in ("html", "body"):
        return hard, False, main
    if main:
        gone = bool(words & _OTHERS)
        return hard or gone, False, main and not gone
    plain = {re.sub(r"[^a-z]", "", n) for n in names}
    said = bool(plain & _WORDS) or any(n.endswith(_ENDINGS) for n in plain) or ("header" in plain and not inside and tag not in _HEADINGS)
    part = bool(words & _WORDS) or ("header" in words and not inside and tag not in _HEADINGS)
    whole = part and words <= _WORDS | _FILL
    return hard or ((said or whole) and tag not in _HEADINGS), part or said, False


def page_lines(source: str) -> list[tuple[int, str]]:
    """The blocks of a page in order, each with MAIN, OPEN or HARD, the first two perhaps with SOFT; white space is folded, references
    are decoded. The time is in proportion to the page's size, whatever its markup."""
    lines: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    opened: Counter = Counter()
    parts: list[str] = []
    at, n, level = 0, len(source), OPEN
    raw_ends: dict[str, int] = {}

    def flush():
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                lines.append((level, text))
            parts.clear()

    while at < n:
        begin = source.find("<", at)
        if begin < 0:
            parts.append(source[at:])
            break
        if begin > at:
            parts.append(source[at:begin])
        follows = source[begin + 1 : begin + 2]
        if follows in ("!", "?") and follows:
            if source.startswith("<!--", begin):
                end = source.find("-->", begin + 4)
                at = end + 3 if end >= 0 else n
            elif source.startswith("<![CDATA[", begin):
                end = source.find("]]>", begin + 9)
                parts.append(html.escape(source[begin + 9 : end if end >= 0 else n]))
                at = end + 3 if end >= 0 else n
            else:
                end = source.find(">", begin)
                at = end + 1 if end >= 0 else n
            continue
        close = follows == "/"
        name = _NAME.match(source, begin + 1 + close)
        if not name:
            parts.append("<")
            at = begin + 1
            continue
        tag = name[0].lower()
        end = _ATTRS.match(source, name.end()).end()
        attrs, at = source[name.end() : end], end + 1
        if close:
            if tag in _BLOCKS:
                flush()
            if opened[tag]:
                flush_needed = tag not in _BLOCKS
                while stack:
                    t, before = stack.pop()
                    opened[t] -= 1
                    if before != level:
                        if flush_needed:
                            flush()
                        level = before
                    if t == tag:
                        break
            continue
        alone = attrs.rstrip().endswith("/")
        if tag in _RAW and not alone:
            if raw_ends.get(tag, 0) >= 0:
                found = re.compile(rf"</{re.escape(tag)}\s*+>", re.I).search(source, at)
                raw_ends[tag] = found.end() if found else -1
            at = raw_ends[tag] if raw_ends[tag] >= 0 else n
            parts.append(" ")
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            else:
                parts.append(" " if tag == "br" else "")
            continue
        if tag in _BLOCKS:
            flush()
            if tag in _CLOSES_P and opened["p"]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        level = stack[k][1]
                        opened.subtract(t for t, _ in stack[k:])
                        del stack[k:]
                        break
                    if stack[k][0] in _CLOSES_P:
                        break
        if alone and tag not in _BLOCKS:
            continue
        hard, soft, main = _kind(tag, attrs, level & ~SOFT == MAIN)
        new = HARD if level == HARD or hard else MAIN if main else level | SOFT if soft else level
        if new != level and tag not in _BLOCKS:
            flush()
        stack.append((tag, level))
        opened[tag] += 1
        level = new
    flush()
    return lines


def shared_lines(a: list[int], b: list[int]) -> list[bool]:
    """For each item of a, whether a longest common subsequence of a and b takes it (bit-parallel, Hirschberg halves)."""
    taken = [False] * len(a)
    both = set(a) & set(b)
    where = [k for k, v in enumerate(a) if v in both]
    a, b = [a[k] for k in where], [v for v in b if v in both]

    def lengths(x: list[int], y: list[int]) -> list[int]:
        """LCS length of x with every prefix of y, in blocks of y that hand a carry for each item of x to the next."""
        out, count, carries = [0], 0, [0] * len(x)
        for k in range(0, len(y), LCS_BLOCK):
            part = y[k : k + LCS_BLOCK]
            masks: dict[int, int] = {}
            for j, v in enumerate(part):
                masks[v] = masks.get(v, 0) | 1 << j
            width = len(part)
            full = (1 << width) - 1
            row = full
            for i, v in enumerate(x):
                hit = row & masks.get(v, 0)
                total = row + hit + carries[i]
                carries[i] = total >> width
                row = (total | (row - hit)) & full
            for digit in reversed(format(~row & full, f"0{width}b")):
                count += digit == "1"
                out.append(count)
        return out

    found = [False] * len(a)
    work = [(0, len(a), 0, len(b))]
    while work:
        i, j, k, m = work.pop()
        while i < j and k < m and a[i] == b[k]:
            found[i] = True
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            found[j] = True
        if i == j or k == m:
            continue
        if j - i == 1:
            found[i] = a[i] in b[k:m]
            continue
        half = (i + j) // 2
        head, tail = lengths(a[i:half], b[k:m]), lengths(a[half:j][::-1], b[k:m][::-1])[::-1]
        cut = max(range(m - k + 1), key=lambda c: head[c] + tail[c])
        work += [(i, half, k, k + cut), (half, j, k + cut, m)]
    for k, f in zip(where, found, strict=True):
        taken[k] = f
    return taken


def _path_parts(path: str) -> list[str]:
    return [x for x in path.split("/") if x]


def _near(path: str, other: str) -> int:
    n = 0
    for x, y in zip(_path_parts(path), _path_parts(other), strict=False):
        if x != y:
            break
        n += 1
    return n


def _words(lines: list[tuple[int, str]]) -> Counter:
    return Counter(w for k, t in lines if k != HARD for w in t.split())


def word_pairs(lines: list[tuple[int, str]]) -> frozenset:
    """The pairs of neighbouring words of a page's lines."""
    words = " ".join(t for k, t in lines if k != HARD).split()
    return frozenset(zip(words, words[1:], strict=False))


def near_copy(a: frozenset, b: frozenset) -> bool:
    """Whether one of two pages has few word pairs that the other lacks: a changed word changes two pairs."""
    both = len(a & b)
    return len(a) - both <= 2 * OWN_SHARE * len(a) or len(b) - both <= 2 * OWN_SHARE * len(b)


def _both_own(page: list[tuple[int, str]], other: list[tuple[int, str]], found: list[bool]) -> bool:
    """Whether both pages have lines of their own with other words: lines of a near copy differ in few words, or one page has them all."""
    common = Counter(x for x, s in zip(page, found, strict=True) if s)
    left = []
    for x in other:
        if common[x] > 0:
            common[x] -= 1
        else:
            left.append(x)
    mine, theirs = _words([x for x, s in zip(page, found, strict=True) if not s]), _words(left)
    return (mine - theirs).total() >= OWN_SHARE * max(1, _words(page).total()) and (theirs - mine).total() >= OWN_SHARE * max(1, _words(other).total())


def difference(page: list[tuple[int, str]], others: list[list[tuple[int, str]]]) -> tuple[str, int]:
    """The main text of a page and its number of lines shared with the nearest of the others that is no copy of it."""
    shared = [False] * len(page)
    mine = [hash(t) for _, t in page]
    weight = sum(len(t) for k, t in page if k != HARD)
    for other in others:
        found = shared_lines(mine, [hash(t) for _, t in other])
        common = sum(len(t) for (k, t), s in zip(page, found, strict=True) if s and k != HARD)
        if common < COPY_SHARE * max(1, weight, sum(len(t) for k, t in other if k != HARD)) or _both_own(page, other, found):
            shared = found
            break
    has_main = any(k & ~SOFT == MAIN for k, _ in page)
    kept = [t for (k, t), s in zip(page, shared, strict=True) if k == MAIN or (not s and (k == MAIN | SOFT or (k != HARD and not has_main)))]
    return "\n\n".join(kept), sum(shared)


def lines_digest(lines: list[tuple[int, str]]) -> int:
    said = "\n".join(f"{k} {t}" for k, t in lines)
    return int.from_bytes(hashlib.blake2b(said.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _digest(page):
    @F.arrow_udf("long")
    def digest(pages: pa.Array) -> pa.Array:
        return pa.array([lines_digest(page_lines(x.as_py() or "")) for x in pages], pa.int64())

    return digest(page)


def _stream(batches):
    """Rows in order of bucket and key; each own row is differenced with the REACH nearest other line lists of its host on either side, then
    with the last list before its run of near copies, however long the run is.

    Consecutive rows with equal lists form one group, which waits until REACH other lists followed it or the host ends.
    """
    names = ("page_id", "url", "text", "n_chars", "n_shared")
    out: dict[str, list] = {k: [] for k in names}
    place, count = None, 0
    before: dict[int, dict] = {}  # the last pages with different lists, latest last
    seen: dict[int, int] = {}  # the last group of a list
    waiting: list[dict] = []
    far: dict | None = None  # the last list before the present run of near copies

    def settle(g: dict) -> None:
        results = {}
        for page_id, url, path in g["members"]:
            around = [(-_near(path, r["path"]), d, side, r) for side in (0, 1) for d, r in enumerate(g["sides"][side])]
            around.sort(key=lambda x: x[:3])
            order = tuple(x[1:3] for x in around)
            if order not in results:
                results[order] = difference(g["lines"], [x[3]["lines"] for x in around] + ([g["far"]["lines"]] if g["far"] else []))
            text, n = results[order]
            for name, value in zip(names, (page_id, url, text, len(text), n), strict=True):
                out[name].append(value)
        g["settled"] = True

    def drain() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array(v, pa.string() if k in ("url", "text") else pa.int64()) for k, v in out.items()], list(names))
        for v in out.values():
            v.clear()
        return done

    def end() -> None:
        for g in waiting:
            if not g["settled"]:
                settle(g)
        waiting.clear()
        before.clear()
        seen.clear()

    for batch in batches:
        for r in batch.to_pylist():
            if (r["bucket"], r["host"]) != place or not r["host"]:
                end()
                far = None
                place, count = (r["bucket"], r["host"]), 0
            lines = page_lines(r["html"] or "")
            digest = lines_digest(lines)
            member = [(r["page_id"], r["url"], r["path"])] if r["own"] else []
            if waiting and waiting[-1]["digest"] == digest:
                waiting[-1]["members"] += member
                continue
            r = {"path": r["path"], "lines": before[digest]["lines"] if digest in before else lines, "pairs": before[digest]["pairs"] if digest in before else word_pairs(lines)}
            last = seen.get(digest, -1)
            for g in reversed(waiting):  # groups up to the last one of this list have it
                if g["number"] < last:
                    break
                if not g["settled"] and g["digest"] != digest:
                    g["sides"][1].append(r)
                    if len(g["sides"][1]) == REACH:
                        settle(g)
            while waiting and waiting[0]["settled"]:
                waiting.pop(0)
            sides = [x for d, x in reversed(before.items()) if d != digest][:REACH], []
            latest = next(reversed(before.values()), None)
            if latest and not near_copy(latest["pairs"], r["pairs"]):
                far = latest
            waiting.append({"far": far, "number": count, "digest": digest, "lines": r["lines"], "members": member, "sides": sides, "settled": False})
            seen[digest] = count
            count += 1
            before.pop(digest, None)
            before[digest] = r
            if len(before) > REACH + 1:
                before.pop(next(iter(before)))
        yield drain()
    end()
    yield drain()


def _buckets(keys: DataFrame) -> tuple[DataFrame, list[str]]:
    """Keys with their bucket: ranges of the key order with about equal numbers of rows. The bounds are drawn from the keys with the
    smallest hashes; they decide which task takes a page, and the result only of a run of near copies that crosses one: beyond a
    bound such a run sees REACH other lists, not what came before its beginning."""
    spark = keys.sparkSession
    n = max(1, min(MAX_DRAWS // 4, max(int(spark.conf.get("spark.sql.shuffle.partitions")), keys.count() // ROWS_A_BUCKET)))
    draws = n * max(4, min(32, MAX_DRAWS // n))
    drawn = sorted(r["key"] for r in keys.orderBy(F.xxhash64("key"), "key").limit(draws).collect())
    bounds = sorted({drawn[len(drawn) * i // n] for i in range(1, n)} if drawn else ())
    return keys.withColumn("bucket", _bucket(bounds)("key")), bounds


def _bucket(bounds: list[str]):
    @F.pandas_udf("int")
    def find(key: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(bounds, k) for k in key], dtype="int32")

    return find


def _halo(keys: DataFrame) -> list[tuple[str, int]]:
    """(key, bucket) of the rows outside each bucket that its rows can be paired with: the nearest row of each of the REACH + 1 nearest
    line lists before its first and after its last row."""
    def edge(nearest, order):
        place = Window.partitionBy("bucket").orderBy(order("key"))
        lists = keys.groupBy("bucket", "host", "digest").agg(nearest("key").alias("key"))
        found = lists.withColumn("i", F.row_number().over(place)).filter(F.col("i") <= REACH + 1).collect()  # REACH + 1 rows a bucket at most
        out: dict[int, list] = {}
        for r in sorted(found, key=lambda r: r["i"]):
            out.setdefault(r["bucket"], []).append(((r["host"], r["digest"]), r["key"]))
        return out

    heads, tails = edge(F.min, F.asc), edge(F.max, F.desc)
    out = set()
    for ends, step in ((tails, 1), (heads, -1)):
        near: dict[tuple, str] = {}  # nearest first
        for b in sorted(ends)[::step]:
            out.update((key, b) for key in near.values())
            merged = dict(ends[b])
            for name, key in near.items():
                merged.setdefault(name, key)
            near = dict(list(merged.items())[: REACH + 1])
    return sorted(out)


def main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points), n_shared (lines shared with the page it was paired with).

    Null or empty html gives an empty text. A null or hostless url is paired with nothing. Repeated rows and equal URLs
    are neighbours and, as copies, skipped in pairing: pages with equal lines are passed over until others of the host are found. Near
    copies, whose own lines differ in few words, are passed over as far as REACH different line lists on either side, and then back to the
    last page before the run of near copies; a run that begins its host (or its range of rows) has only the former. Other columns are not read. Every page is parsed whole. The html is
    shuffled once, into ranges of the order by host and path; rows near a range's ends also go to the next range.
    """
    url = F.col("url").cast("string")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"), path.alias("path"))
    key = F.concat_ws("\x01", "host", "path", F.coalesce(F.lpad(F.hex("page_id"), 16, "0"), F.lit("")), F.coalesce("url", F.lit("")), F.hex(F.xxhash64("html")))
    rows = rows.withColumn("key", key)
    keys, bounds = _buckets(keep(rows.select("key", "host", _digest("html").alias("digest")), "keys"))
    spark = pages.sparkSession
    edges = _halo(keep(keys, "buckets"))
    halo = spark.createDataFrame(edges, "at string, bucket int")
    halo = F.broadcast(halo) if len(edges) <= MAX_BROADCAST else halo
    own = rows.withColumns({"bucket": _bucket(bounds)("key"), "own": F.lit(True)})
    near = rows.join(halo, F.col("key") == F.col("at")).drop("at").withColumn("own", F.lit(False))
    placed = own.unionByName(near).repartition(len(bounds) + 1, "bucket").sortWithinPartitions("bucket", "key")
    return placed.mapInArrow(_stream, "page_id long, url string, text string, n_chars long, n_shared long")
