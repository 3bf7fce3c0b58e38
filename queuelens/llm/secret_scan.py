"""Secrets by assignment-aware lexing.

Three base patterns (kinds assign, access, hex) are fixed by contract. On top of them a small lexer reads source and
configuration syntax (assignments, mappings, XML elements and properties, YAML block scalars) as (name, literal) pairs, joins adjacent and `+`-chained literals, follows constants that are assigned to
other names, and scores each literal by how sensitive its target's name is and how random it looks.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the base kinds. Only A-Z and a-z fold, so classes are written out instead of using re.I.
_KEY = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
ASSIGN = re.compile(rf"""({_KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "lexed")
MIN_ASSIGN, MIN_ACCESS = 6, 20

# Parts of names and how sensitive they are.
NAME_SCORES = {"password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "secrets": 3, "token": 3, "apikey": 3, "credential": 3, "credentials": 3, "privatekey": 3, "bearer": 2, "auth": 2, "authorization": 2, "dsn": 2, "cookie": 1, "session": 1, "signature": 2, "salt": 1}
_KEY_WORDS = frozenset("api access private auth encryption signing master client service account".split())
_ENDINGS = ("apikey", "privatekey", "passphrase", "password")
#: A name that scores has one of these parts (`key`: no word of _KEY_WORDS counts without it) or one of the _ENDINGS.
_STEMS = (*NAME_SCORES, "key")
_APART = re.compile(r"[^a-z0-9]+")
PLACEHOLDERS = frozenset("changeme change_me password passwd secret token example placeholder redacted none null true false undefined your_password your_token todo".split())
LEAST_SCORE = 4.0
MIN_LITERAL = 8

# Possessive quantifiers: no text makes a pattern go back over what it has read.
_STATEMENT = re.compile(r"""(?<![\w.$-])(?:(["'])([A-Za-z_$][\w.$ -]*)\1|([A-Za-z_$][\w.$-]*+))[ \t]*+(?::[ \t]*+[A-Za-z_][\w\[\], ]*?(?==))?(:=|=>|=(?!=)|:(?![:/]))[ \t]*+""")
_LITERAL = 8

_STATEMENT = re.compile(r"""(?<![\w.$-])(?:(["'])([A-Za-z_$][\w.$ -]*)\1|([A-Za-z_$][\w.$-]*))[ \t]*(?::[ \t]*[A-Za-z_][\w\[\], ]*?(?==))?[ \t]*(:=|=>|=(?!=)|:(?![:/]))[ \t]*""")
_LITERAL = re.compile(r""""((?:[^"\\\n]++|\\.)*+)"|'((?:[^'\\\n]++|\\.)*+)'|`([^`\n]*+)`""")
_BARE = re.compile(r"[^\s\"'`,;(){}\[\]#<>]+")
_NAME = re.compile(r"[A-Za-z_$][\w.$]*")
_JOIN = re.compile(r"[ \t]*+(?:\+|\.\.|\\\n)?[ \t]*+")
#: `<name>literal<` of XML, `name="password" value="literal"` of property elements, and the start of a YAML block scalar.
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*+)[^<>]*+>[ \t\r\n]*+([^<>\s]++)[ \t\r\n]*+</")
_PROPERTY = re.compile(r"""\b(?:name|key)[ ]?=[ ]?(?:"([^"<>\n]{1,200}+)"|'([^'<>\n]{1,200}+)')[ \t]++value[ ]?=[ ]?(?:"([^"<>\n]++)"|'([^'<>\n]++)')""")
_BLOCK = re.compile(r"(?m)^([ ]*+)(?:-[ ])?([A-Za-z_][\w.-]*+):[ ]*+[|>][+-]?[ ]*+\n")
_LINE = re.compile(r"([ ]*+)([^\n]*+)(?:\n|\Z)")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns: leftmost, non-overlapping per kind; matches that are too short are dropped."""
    found = []
    lower = text.lower()
    if any(w in lower for w in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def name_score(name: str) -> int:
    parts = [p.lower() for p in _PARTS.findall(name)]
    score = max((NAME_SCORES.get(p, 0) for p in parts), default=0)
    joined = "".join(parts)
    if any(joined.endswith(k) for k in _ENDINGS):
        score = max(score, 3)
    if "key" in parts and _KEY_WORDS & set(parts):
        score = max(score, 3)
    return score


def _ends_in_joined(lower: str) -> bool:
    joined = _APART.sub("", lower)
    return any(k in joined for k in _ENDINGS)


def _may_score(text: str) -> bool:
    """Whether some name in the text can score. Parts stand whole in the text; endings may be set apart, as in `pass_word`."""
    lower = text.lower()
    return any(k in lower for k in _STEMS) or _ends_in_joined(lower)


_BARRED = re.compile(r"\$\{|\{\{|<[^<>]*>|%\(|\s")


class Value:
    """What a name holds: spans of literals and the values it was joined from, and what scoring needs to know of the whole.

    Counts stop at 2**20 and values are shared, not copied, so a constant that doubles itself line by line costs no more than any other.
    """

    __slots__ = ("parts", "size", "counts", "barred", "text", "taken")
    MOST = 1 << 20
    KNOWN = 64

    def __init__(self, parts, size, counts, barred, text):
        self.parts, self.size, self.counts, self.barred, self.text, self.taken = parts, size, counts, barred, text, False

    @classmethod
    def literal(cls, start: int, end: int, text: str) -> Value:
        counts = Counter(c if c < "\x80" else chr(128 + ord(c) % 128) for c in text)
        return cls(((start, end),), len(text), counts, bool(_BARRED.search(text)) or text.startswith("$"), text if len(text) <= cls.KNOWN else None)

    @classmethod
    def joined(cls, values: list[Value]) -> Value:
        if len(values) == 1:
            return values[0]
        counts: Counter = Counter()
        for v in values:
            counts.update(v.counts)
        known = all(v.text is not None for v in values) and sum(v.size for v in values) <= cls.KNOWN
        text = "".join(v.text for v in values) if known else None
        return cls(tuple(values), min(cls.MOST, sum(v.size for v in values)), {c: min(n, cls.MOST) for c, n in counts.items()}, any(v.barred for v in values), text)

    def score(self) -> float:
        """0 for placeholders and references; else up to 3 by length, kinds of characters and entropy."""
        if self.size < MIN_LITERAL or self.barred or (self.text is not None and self.text.lower() in PLACEHOLDERS):
            return 0.0
        total = sum(self.counts.values())
        entropy = -sum(n / total * math.log2(n / total) for n in self.counts.values())
        if entropy < 2.0:
            return 0.0
        seen = "".join(self.counts)
        kinds = sum(bool(re.search(k, seen)) for k in ("[a-z]", "[A-Z]", "[0-9]", r"[^\w]"))
        return min(3.0, 0.5 * kinds + 0.5 * (entropy >= 3.0) + 0.5 * (self.size >= 16) + 0.5 * bool(re.search("[0-9]", seen)))

    def take(self, found: set[tuple[int, int]]) -> None:
        """Adds all spans; each value is visited once in its life."""
        todo = [self]
        while todo:
            v = todo.pop()
            if not v.taken:
                v.taken = True
                for p in v.parts:
                    if isinstance(p, Value):
                        todo.append(p)
                    elif p[1] > p[0]:
                        found.add(p)


def literal_score(text: str) -> float:
    return Value.literal(0, len(text), text).score()


def _judge(name: str, value: Value, found: set[tuple[int, int]]) -> None:
    sensitive = name_score(name)
    if sensitive:
        score = value.score()
        if score >= 1.0 and sensitive + score >= LEAST_SCORE:
            value.take(found)


def _statements(text: str, found: set[tuple[int, int]]) -> None:
    """name = literal, name: literal, name => literal and the like; names of constants stand for what they hold, the latest counting."""
    constants: dict[str, Value] = {}
    at = 0
    while m := _STATEMENT.search(text, at):
        at = m.end()
        name, quoted_only = m[2] or m[3], m[4] in (":", "=>")
        pieces: list[Value] = []
        direct = False
        while True:
            if lit := _LITERAL.match(text, at):
                k = next(i for i in (1, 2, 3) if lit[i] is not None)
                pieces.append(Value.literal(lit.start(k), lit.end(k), lit[k]))
                direct, at = True, lit.end()
            elif (ref := _NAME.match(text, at)) and ref[0] in constants:
                pieces.append(constants[ref[0]])
                at = ref.end()
            elif not pieces and (bare := _BARE.match(text, at)):
                pieces.append(Value.literal(bare.start(), bare.end(), bare[0]))
                at = bare.end() if not _NAME.fullmatch(bare[0]) else at
                break
            else:
                break
            gap = _JOIN.match(text, at)
            if "+" not in gap[0] and ".." not in gap[0] and not text[gap.end() : gap.end() + 1] in ("'", '"'):
                break
            at = gap.end()
        if pieces:
            value = Value.joined(pieces)
            if direct or not quoted_only:
                constants[name] = value
            _judge(name, value, found)


def _markup(text: str, found: set[tuple[int, int]]) -> None:
    """Pairs of XML elements and of name/value attributes."""
    for m in _ELEMENT.finditer(text):
        _judge(m[1], Value.literal(m.start(2), m.end(2), m[2]), found)
    for m in _PROPERTY.finditer(text):
        k = 3 if m[3] is not None else 4
        _judge(m[1] or m[2], Value.literal(m.start(k), m.end(k), m[k]), found)


def _block_scalars(text: str, found: set[tuple[int, int]]) -> None:
    """YAML `name: |` with its more deeply indented lines, each a piece of the literal."""
    done = 0
    for m in _BLOCK.finditer(text):
        if m.start() < done or not name_score(m[2]):
            continue
        pieces, at = [], m.end()
        while at < len(text) and (line := _LINE.match(text, at)) and (len(line[1]) > len(m[1]) or not line[2].strip()):
            body = line[2].rstrip()
            if body:
                pieces.append(Value.literal(line.start(2), line.start(2) + len(body), body))
            at = line.end()
        done = at
        if pieces:
            _judge(m[2], Value.joined(pieces), found)


def lexed_spans(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name, directly, in parts, or through constants."""
    if not ("=" in text or ":" in text or "</" in text) or not _may_score(text):
        return []
    found: set[tuple[int, int]] = set()
    _statements(text, found)
    if "</" in text or "value" in text:
        _markup(text, found)
    if "|" in text or ">" in text:
        _block_scalars(text, found)
    return sorted(found)


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: a lexed literal inside a base span of kind assign is not said again."""
    base = base_spans(text)
    starts, ends = [a for a, k, _ in base if k == 0], [b for _, k, b in base if k == 0]  # they don't overlap

    def covered(a: int, b: int) -> bool:
        k = bisect.bisect_right(starts, a) - 1
        return k >= 0 and b <= ends[k]

    return base, sorted(base + [(a, 3, b) for a, b in lexed_spans(text) if not covered(a, b)])


def _scanner(batches):
    for batch in batches:
        out = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_lexed", "base_sha256", "spans")}
        for text in batch.column(1):
            base, spans = scan(text.as_py() or "")
            kinds = Counter(k for _, k, _ in spans)
            values = (kinds[0], kinds[1], kinds[2], kinds[3], hashlib.sha256(spans_text(base).encode()).hexdigest(), spans_text(spans))
            for name, value in zip(out, values, strict=True):
                out[name].append(value)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.string() if isinstance(k, str) and k in ("base_sha256", "spans") else pa.int64()) for k, v in out.items())], ["doc_id", *out])


def secret_spans(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex (base kinds), n_lexed, base_sha256, spans (kind:start:end in code points, by start).

    Null and empty texts have no spans. Repeated rows give repeated results; a null doc_id is returned as null; other columns
    are not read. Texts are scanned whole.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scanner, "doc_id long, n_assign long, n_access long, n_hex long, n_lexed long, base_sha256 string, spans string")
