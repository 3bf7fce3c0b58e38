"""Exact n-gram Jaccard join by T-occurrence search, spread over a cluster.

Documents are sets of distinct 5-word shingles (64-bit hashes); two link at Jaccard >= 3/4. The search:

1. Document frequencies of all shingles are counted from packed, sorted blobs. Frequent shingles (the *long* lists)
   come last in a global order; any order is correct, so the bound on the broadcast list of frequent shingles
   only affects speed, never results.
2. Equal sets collapse to one class. A set of n shingles puts its first n - ceil(3n/4) + 1 shingles in that order
   (the *short* lists) into the inverted index: sets that link share at least one of them.
3. Each index shard merges its lists; the number of shards follows the input. Lists of up to SHORT sets give all pairs of
   fitting sizes; longer ones give a star around their largest set, and stay open.
4. `Lists.search` (DivideSkip) retains the sets that reach the required overlap: it merges the short inverted lists of
   a group and binary-probes its long ones.
5. The sets of open lists are searched in each other, in blocks, so no link is lost. Where only components are asked for, lists
   whose sets the verified links have put into one component are passed over. Where links are counted, all are searched,
   each pair of sets in one cell, and counts, not pairs, are returned.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, keep, shingle_sets, text_buffers

WIDTH = 5
#: Bytes of text for each index shard, about. Bits of a shingle hash choose the shard; shingles are counted by REST more bits.
SHARD_BYTES = 16 << 20
MIN_BITS, MAX_BITS, REST = 6, 24, 24
FREQUENT = 16
#: Most frequent shingles sent to every executor (9 bytes each). Beyond it only the most frequent ones are sent.
MAX_FREQUENT = 2_000_000
SHORT = 15
#: Sets and shingles of a block of an open list, at most about: two blocks meet in a task's memory.
BLOCK = 4096
BLOCK_SHINGLES = 1 << 20
FLUSH = 2_000_000
#: A shingle with so many sets in one flush is hot: its list is open anyway, and its sets do not meet in one task. The shard learns of its
#: largest set, and a second pass over the prefixes gives the list's members where they are.
HOT = 256
#: Hot shingles broadcast at most (24 bytes each); beyond it entries are joined with them, salted.
MAX_HOT = 2_000_000
_MARK = 1 << 31
#: Most pairs of ids broadcast to pick texts; beyond it the same join shuffles, with salt where a key may be hot.
MAX_BROADCAST_PAIRS = 1_000_000
SALTS = 32


def required(a, b):
    """Least overlap of sets of sizes a and b at 100 * overlap >= 75 * union."""
    return -(-75 * (a + b) // 175)


class Lists:
    """Inverted lists over some sets (each sorted and distinct), searched by DivideSkip."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.sizes = np.array([len(x) for x in sets], np.int64)
        tokens, owner = np.concatenate([*sets, np.zeros(0, U64)]), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, self.owner = tokens[order], owner[order]
        self.starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.zeros(0, np.int64)
        self.tokens = tokens[self.starts]
        self.lengths = np.diff(np.append(self.starts, len(tokens)))

    def search(self, query: np.ndarray, allowed: np.ndarray | None = None, mu: float = 1.0) -> list[int]:
        """Sets that reach the required overlap with the query.

        Of the lists of the query's tokens the L longest are put aside and the short ones merged into occurrence counts; only sets
        with at least T - L of them are probed in the long lists by binary search.
        """
        if not len(query) or not len(self.tokens):
            return []
        need = required(len(query), self.sizes)
        at = np.searchsorted(self.tokens, query)
        at[at == len(self.tokens)] = 0
        at = at[self.tokens[at] == query]
        if not len(at):
            return []
        lengths = self.lengths[at]
        t = int(need.min())
        n_long = max(0, min(t - 1, len(at), int(t / (mu * np.log2(max(2, lengths.max())) + 1))))
        by_length = np.argsort(lengths, kind="stable")
        short, long = at[by_length[: len(at) - n_long]], np.sort(at[by_length[len(at) - n_long :]])
        n = self.lengths[short]
        places = np.repeat(self.starts[short] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum())) if len(short) else np.zeros(0, np.int64)
        merged = np.bincount(self.owner[places], minlength=len(self.sets))
        likely = merged >= np.maximum(need - n_long, 0)
        if allowed is not None:
            likely &= allowed
        at = np.flatnonzero(likely)
        count = merged[at]
        for k in long:  # candidates are looked up in each long list by binary search
            members = self.owner[self.starts[k] : self.starts[k] + self.lengths[k]]
            place = np.searchsorted(members, at)
            inside = place < len(members)
            count[inside] += members[place[inside]] == at[inside]
        return at[(count >= need[at]) & (self.sizes[at] > 0)].tolist()


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each number, byte by byte in planes: sorted numbers then compress well."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unplanes(blob: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _by_shard(sorted_tokens: np.ndarray, rest_bits: int):
    shard = (sorted_tokens >> U64(rest_bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(shard)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(shard)], strict=True):
        if b > a:
            yield int(shard[a]), slice(a, b)


def shard_bits(docs: DataFrame) -> int:
    """Bits that choose a shard, from the bytes of all texts."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MAX_BITS, max(MIN_BITS, int(size // SHARD_BYTES).bit_length()))


def _count_blobs(bits: int):
    """Shingles with their counts, by shard: summed here first, so a shingle of most documents is one entry a flush."""
    schema = pa.schema([("shard", pa.int32()), ("tokens", pa.binary()), ("counts", pa.binary())])

    def flush(held):
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        mask = U64((1 << REST) - 1)
        rows = [(k, _planes(tokens[s] & mask, 3), _planes(counts[s], 3)) for k, s in _by_shard(tokens, REST)]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for _, s in shingle_sets(*text_buffers(batch.column(0)), WIDTH):
                for part in np.array_split(s, len(s) // FLUSH + 1):
                    held.append(part >> U64(64 - bits - REST))
                    n += len(part)
                    if n >= FLUSH:
                        yield flush(held)
                        held, n = [], 0
        if n:
            yield flush(held)

    return run


def _frequent(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    tokens, counts = (np.concatenate([_unplanes(x.as_py(), 3) for x in table[k]]) for k in ("tokens", "counts"))
    order = np.argsort(tokens, kind="stable")
    tokens = tokens[order]
    starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
    counts = np.add.reduceat(counts[order].astype(np.int64), starts)
    often = counts >= FREQUENT
    full = tokens[starts[often]].astype(np.int64) + (key[0].as_py() << 24)
    return pa.table({"token": full, "df": counts[often]})


def frequent_shingles(docs: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (their upper bits, sorted) in at least FREQUENT documents, and the rank of their frequency class."""
    blobs = docs.select("text").mapInArrow(_count_blobs(bits), "shard int, tokens binary, counts binary")
    counted = keep(blobs.groupBy("shard").applyInArrow(_frequent, "token long, df long"), "df")
    classes = counted.groupBy(F.floor(F.log2("df")).cast("int").alias("c")).count().collect()  # at most 64 rows
    least, total = 64, 0
    for row in sorted(classes, reverse=True):
        total += row["count"]
        if total > MAX_FREQUENT:
            break
        least = row["c"]
    table = counted.filter(F.col("df") >= F.lit(2.0**least)).toArrow()
    token, df = table["token"].to_numpy(), table["df"].to_numpy()
    order = np.argsort(token)
    return token[order].astype(U64), np.floor(np.log2(np.maximum(df[order], 1))).astype(np.uint8)


def _profiles(frequent, bits: int):
    def run(batches):
        token, rank = frequent.value
        for batch in batches:
            ids, n, digests, prefixes = batch.column(0), [], [], []
            for _, s in shingle_sets(*text_buffers(batch.column(1)), WIDTH):
                n.append(len(s))
                if not len(s):
                    digests.append(None)
                    prefixes.append(None)
                    continue
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                length = len(s) - required_self(len(s)) + 1
                if len(token):
                    short = s >> U64(64 - bits - REST)
                    at = np.minimum(np.searchsorted(token, short), len(token) - 1)
                    known = token[at] == short
                    if known.any():
                        s = s[np.argsort(np.where(known, rank[at], 0), kind="stable")]
                prefixes.append(_planes(s[:length] >> U64(64 - bits - 32), 7))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(prefixes, pa.binary())], ["doc_id", "n_shingles", "digest", "prefix"])

    return run


def required_self(n: int) -> int:
    """Least overlap that a set of n shingles needs with any set at all."""
    return -(-3 * n // 4)


def _entries(batches, flush: int):
    """Arrays (token, doc, size) of about `flush` prefix entries."""
    tokens, ids, sizes, n = [], [], [], 0
    for batch in batches:
        for doc, size, prefix in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            t = _unplanes(prefix, 7)
            tokens.append(t)
            ids.append(np.full(len(t), doc, np.int64))
            sizes.append(np.full(len(t), size, np.int64))
            n += len(t)
            if n >= flush:
                yield tuple(np.concatenate(x) for x in (tokens, ids, sizes))
                tokens, ids, sizes, n = [], [], [], 0
    if n:
        yield tuple(np.concatenate(x) for x in (tokens, ids, sizes))


def _index_blobs(hot: int, flush: int):
    schema = pa.schema([("shard", pa.int64()), ("tokens", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary())])

    def run(batches):
        for t, i, z in _entries(batches, flush):
            order = np.lexsort((i, -z, t))
            t, i, z = t[order], i[order], z[order]
            first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
            many = np.diff(np.append(first, len(t))) >= hot
            taken = np.repeat(~many, np.diff(np.append(first, len(t))))
            z[first[many]] |= _MARK
            taken[first[many]] = True
            t, i, z = t[taken], i[taken], z[taken].astype(U64)
            rows = [(k, _planes(t[s], 4), _planes(i[s].view(U64), 8), _planes(z[s], 4)) for k, s in _by_shard(t, 32)]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _list_rows(kind: np.ndarray, token: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(token.astype(np.int64)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], ["kind", "token", "a", "b"])


def _hot_members(hot, flush: int):
    """Of the (broadcast) hot tokens with their leads: rows (kind 1) of all members, and pairs (kind 0) of the lead with those of fitting size."""

    def run(batches):
        token, lead, lead_size = hot.value
        for t, i, z in _entries(batches, flush):
            at = np.minimum(np.searchsorted(token, t), len(token) - 1)
            mine = token[at] == t
            t, i, z, at = t[mine], i[mine], z[mine], at[mine]
            near = _fits(np.minimum(z, lead_size[at]), np.maximum(z, lead_size[at])) & (i != lead[at])
            large = lead_size[at] >= z
            x, y = np.where(large, lead[at], i)[near], np.where(large, i, lead[at])[near]
            yield _list_rows(np.repeat([1, 0], [len(t), len(x)]), np.concatenate((t.view(np.int64), np.zeros(len(x), np.int64))), np.concatenate((i, x)), np.concatenate((z, y)))

    return run


def _plain_entries(flush: int):
    def run(batches):
        for t, i, z in _entries(batches, flush):
            yield _list_rows(np.ones(len(t)), t.view(np.int64), i, z)

    return run


def _fits(small, large):
    return 100 * small >= 75 * large


def _merge_shard(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Rows (kind 0): pairs a (the larger set), b. Rows (kind 1): members a of open list `token`, of size b. Rows (kind 2): a hot list `token` with
    its largest set a, of size b."""
    t = np.concatenate([_unplanes(x.as_py(), 4) for x in table["tokens"]])
    i = np.concatenate([_unplanes(x.as_py(), 8) for x in table["ids"]]).view(np.int64)
    z = np.concatenate([_unplanes(x.as_py(), 4) for x in table["sizes"]]).astype(np.int64)
    marked, z = z >= _MARK, z & (_MARK - 1)
    order = np.lexsort((i, -z, t))
    t, i, z, marked = t[order], i[order], z[order], marked[order]
    hot = np.isin(t, t[marked])
    lead = hot & np.concatenate(([True], t[1:] != t[:-1])) if len(t) else hot
    leads = np.stack([(key[0].as_py() << 32) + t[lead].astype(np.int64), i[lead], z[lead]])
    t, i, z = t[~hot], i[~hot], z[~hot]
    if len(t):
        once = np.concatenate(([True], (t[1:] != t[:-1]) | (i[1:] != i[:-1])))
        t, i, z = t[once], i[once], z[once]
    starts = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else np.zeros(0, int)
    lengths = np.diff(np.append(starts, len(t)))
    pairs, opened = set(), []
    for a, length in zip(starts[lengths > 1], lengths[lengths > 1], strict=True):
        ids, sizes = i[a : a + length], z[a : a + length]
        if length <= SHORT:
            for x in range(length):
                for y in range(x + 1, length):
                    if _fits(sizes[y], sizes[x]) and ids[x] != ids[y]:
                        pairs.add((int(ids[x]), int(ids[y])))
            continue
        lead = 0
        for x in range(1, length):
            if not _fits(sizes[x], sizes[lead]):
                lead = x
            elif ids[x] != ids[lead]:
                pairs.add((int(ids[lead]), int(ids[x])))
        opened.append(np.stack([np.full(length, (key[0].as_py() << 32) + int(t[a])), ids, sizes]))
    links = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    more = np.concatenate(opened, axis=1) if opened else np.zeros((3, 0), np.int64)
    kind = np.repeat([0, 1, 2], [len(links), more.shape[1], leads.shape[1]])
    return pa.Table.from_batches([_list_rows(kind, np.concatenate([np.zeros(len(links), np.int64), more[0], leads[0]]), np.concatenate([links[:, 0], more[1], leads[1]]), np.concatenate([links[:, 1], more[2], leads[2]]))])


LIST_ROW = "kind int, token long, a long, b long"


def with_hot_lists(lists: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The rows of lists with members and pairs of the hot ones, which their shards left out."""
    hot = lists.filter("kind = 2").select("token", "a", "b")
    n = hot.count()
    if not n:
        return lists
    if n <= MAX_HOT:
        table = hot.orderBy("token").toArrow()
        known = lists.sparkSession.sparkContext.broadcast((table["token"].to_numpy().view(U64), table["a"].to_numpy(), table["b"].to_numpy()))
        more = prefixes.mapInArrow(_hot_members(known, FLUSH), LIST_ROW)
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        leads = hot.select("token", F.col("a").alias("lead"), F.col("b").alias("lead_size"), salts)
        at = prefixes.mapInArrow(_plain_entries(FLUSH), LIST_ROW).withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int")).join(leads, ["token", "salt"])
        small, large = F.least("b", "lead_size"), F.greatest("b", "lead_size")
        first = F.col("lead_size") >= F.col("b")
        pairs = at.filter((100 * small >= 75 * large) & (F.col("a") != F.col("lead"))).select(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("token"), F.when(first, F.col("lead")).otherwise(F.col("a")).alias("a"), F.when(first, F.col("a")).otherwise(F.col("lead")).alias("b"))
        more = at.select("kind", "token", "a", "b").unionByName(pairs)
    return lists.filter("kind < 2").unionByName(keep(more, "hot"))


def _groups(*keys: np.ndarray):
    """Slices of rows with equal keys, as index arrays."""
    order = np.lexsort(keys[::-1])
    change = np.zeros(len(order), bool)
    for k in keys:
        change[1:] |= k[order][1:] != k[order][:-1]
    return np.split(order, np.flatnonzero(change))


def _verify(table: pa.Table) -> pa.Table:
    sets = [s for _, s in shingle_sets(*text_buffers(table["text"]), WIDTH)]
    a, cell, doc, lead = (table[k].to_numpy() for k in ("a", "cell", "doc", "lead"))
    found = set()
    for rows in _groups(a, cell):
        members = [k for k in rows if not lead[k]]
        lists = Lists([sets[m] for m in members])
        for k in rows:
            if lead[k]:
                found.update((int(doc[k]), int(doc[members[c]])) for c in lists.search(sets[k]))
    x, y = zip(*sorted(found), strict=True) if found else ((), ())
    return pa.table({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})


def verify_pairs(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of doc_ids that link; `pairs` is a written table.

    Cells hold a set a and up to about 256 sets b, groups some cells: neither grows with the input.
    """
    n = pairs.count()
    per_lead = pairs.groupBy("a").agg(F.ceil(F.count("*") / 256).alias("cells"))
    cells = pairs.join(per_lead, "a").select("a", "b", F.pmod(F.xxhash64("b"), "cells").alias("cell"))
    leads = cells.select("a", "cell").distinct()
    if n <= MAX_BROADCAST_PAIRS:
        cells, leads = F.broadcast(cells), F.broadcast(leads)
    texts = docs.select(F.col("doc_id").alias("doc"), "text")
    rows = texts.join(cells, F.col("doc") == F.col("b")).select("a", "cell", "doc", "text", F.lit(False).alias("lead"))
    rows = rows.unionByName(texts.join(leads, F.col("doc") == F.col("a")).select("a", "cell", "doc", "text", F.lit(True).alias("lead")))
    return rows.groupBy(F.pmod(F.xxhash64("a", "cell"), F.lit(max(64, n // 512))).alias("group")).applyInArrow(_verify, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node with an edge.

    Each round every node takes its smallest neighbour as parent, edges move to the parents, and what fell together is
    dropped; the number of nodes with edges at least halves.
    """
    edges = keep(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).select("node", F.least("node", "up").alias("up")), "parents")
        root = keep(parent.alias("p").join(parent.alias("q"), F.col("p.up") == F.col("q.node"), "left").select("p.node", F.coalesce("q.up", "p.up").alias("root")), "roots")
        if labels is None:
            labels = root
        else:
            labels = keep(labels.join(root.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        x = root.select(F.col("node").alias("a"), F.col("root").alias("x"))
        y = root.select(F.col("node").alias("b"), F.col("root").alias("y"))
        edges = keep(edges.join(x, "a").join(y, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _search(counting: bool):
    """Within each cell: rows (kind 1) of links across components, as few as join what the cell's links join; and, counting, rows
    (kind 0) of each set with the weight of the sets it links with."""

    def run(table: pa.Table) -> pa.Table:
        sets = [s for _, s in shingle_sets(*text_buffers(table["text"]), WIDTH)]
        x, y, doc, component, weight, row, col = (table[k].to_numpy() for k in ("x", "y", "doc", "component", "weight", "is_row", "is_col"))
        found, degree = [], {}
        for cell in _groups(x, y):
            cols = cell[col[cell]]
            lists, owners, up = Lists([sets[k] for k in cols]), component[cols], {}
            back, one_block = np.zeros(len(cols), np.int64), x[cell[0]] == y[cell[0]]

            def root(v, up=up):
                while up.setdefault(v, v) != v:
                    up[v] = v = up[up[v]]
                return v

            for k in cell[row[cell]]:
                linked = np.array(lists.search(sets[k], None if counting else owners != component[k]), np.int64)
                if not len(linked):
                    continue
                for c in linked[owners[linked] != component[k]]:
                    a, b = root(component[k]), root(owners[c])
                    if a != b:
                        up[max(a, b)] = min(a, b)
                        found.append((int(doc[k]), int(doc[cols[c]])))
                if counting:
                    linked = linked[doc[cols[linked]] != doc[k]]
                    degree[doc[k]] = degree.get(doc[k], 0) + int(weight[cols[linked]].sum())
                    if not one_block:
                        back[linked] += weight[k]
            for c in np.flatnonzero(back):
                degree[doc[cols[c]]] = degree.get(doc[cols[c]], 0) + int(back[c])
        rows = [(1, a, b) for a, b in sorted(found)] + [(0, int(a), n) for a, n in sorted(degree.items()) if n]
        kind, a, b = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"kind": pa.array(kind, pa.int32()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _salted(left: DataFrame, right: DataFrame, key: str, by: str, n: int) -> DataFrame:
    """left joined with right on a key that a third of left's rows may share: right (n rows) is broadcast if small, else given to SALTS parts."""
    if n <= MAX_BROADCAST_PAIRS:
        return left.join(F.broadcast(right), key)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__ql_salt")
    return left.withColumn("__ql_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(right.select("*", salts), [key, "__ql_salt"]).drop("__ql_salt")


def open_cells(opened: DataFrame, profile: DataFrame, labels: DataFrame, counting: bool) -> tuple[DataFrame, DataFrame]:
    """(a, component, block) of the sets to search, and the cells (x, y) of blocks that meet in a list.

    A set's home is the longest of its lists; sets of one home form blocks of up to about BLOCK sets and BLOCK_SHINGLES shingles.
    Each set travels once to each of its block's cells and no pairs are written.
    """
    at = opened.select("token", "a").join(labels.select(F.col("node").alias("a"), "root"), "a", "left").select("token", "a", F.coalesce("root", "a").alias("component"))
    lists = at.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"))
    lists = keep((lists if counting else lists.filter("lo <> hi")).select("token", "n"), "open")
    at = keep(_salted(at, lists, "token", "a", lists.count()), "members")
    longest = F.max(F.struct("n", "token"))
    homes = at.groupBy("a", "component").agg(longest.alias("x")).select("a", "component", F.col("x.token").alias("home"))
    homes = keep(homes.join(profile.select(F.col("doc_id").alias("a"), "n_shingles"), "a"), "homes")
    parts = homes.groupBy("home").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).alias("parts")).filter("parts > 1")
    parts = keep(parts, "parts")  # homes of more than one block: few
    many = _salted(homes, parts, "home", "a", parts.count())
    one = homes.join(F.broadcast(parts.select("home")) if parts.count() <= MAX_BROADCAST_PAIRS else parts.select("home"), "home", "left_anti").withColumn("parts", F.lit(1).cast("long"))
    blocks = many.select("a", "component", "home", "parts").unionByName(one.select("a", "component", "home", "parts"))
    blocks = keep(blocks.select("a", "component", F.xxhash64("home", F.pmod(F.xxhash64("a"), "parts")).alias("block")), "blocks")
    meet = at.join(blocks.select("a", "block"), "a").select("token", "block").distinct()
    cells = meet.select("token", F.col("block").alias("x")).join(meet.select("token", F.col("block").alias("y")), "token").filter("x <= y").select("x", "y").distinct()
    return blocks, keep(cells, "cells")


def search_open(docs: DataFrame, blocks: DataFrame, cells: DataFrame, weights: DataFrame, counting: bool) -> DataFrame:
    """What `_search` finds in blocks wherever they meet: (kind, a, b)."""
    heavy = keep(blocks.join(weights, "a"), "weighed")
    rows = cells.join(heavy, F.col("x") == F.col("block")).select("x", "y", "a", "component", "weight", F.lit(True).alias("is_row"), (F.col("x") == F.col("y")).alias("is_col"))
    cols = cells.filter("x < y").join(heavy, F.col("y") == F.col("block")).select("x", "y", "a", "component", "weight", F.lit(False).alias("is_row"), F.lit(True).alias("is_col"))
    placed = keep(rows.unionByName(cols), "placed")
    n = placed.count()
    if n <= MAX_BROADCAST_PAIRS:
        placed = F.broadcast(placed)
    filled = docs.select(F.col("doc_id").alias("doc"), "text").join(placed, F.col("doc") == F.col("a")).drop("a")
    return filled.groupBy(F.pmod(F.xxhash64("x", "y"), F.lit(max(64, n // 512))).alias("group")).applyInArrow(_search(counting), "kind int, a long, b long")


def ngram_join(docs: DataFrame, links: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included); with `links`
    also n_links, the number of other rows it links with.

    Null or empty text: no shingles, linked with nothing. Fewer than five words: one shingle. Rows with equal doc_id are one
    node with several texts and each gets a row (where these differ, n_links is the sum over them, and a row that links with several
    counts for each); a row with null doc_id keeps a null component and links nothing. Other columns are not read, so their names cannot clash. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bits = shard_bits(docs)
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, bits))
    profile = keep(docs.mapInArrow(_profiles(frequent, bits), "doc_id long, n_shingles long, digest binary, prefix binary"), "profile")
    known = profile.filter("digest is not null and doc_id is not null")
    classes = keep(known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight")), "classes")
    unique = known.join(classes.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"], "left_semi")
    shards = unique.select("doc_id", "n_shingles", "prefix").mapInArrow(_index_blobs(HOT, FLUSH), "shard long, tokens binary, ids binary, sizes binary")
    lists = keep(shards.groupBy("shard").applyInArrow(_merge_shard, LIST_ROW), "lists")
    lists = with_hot_lists(lists, unique.select("doc_id", "n_shingles", "prefix"))
    pairs = keep(lists.filter("kind = 0").select("a", "b").distinct(), "pairs")
    verified = keep(verify_pairs(docs, pairs), "links")
    # Classes of one doc_id with several texts meet in that node.
    labels = components(verified)
    opened, sized = lists.filter("kind = 1"), unique.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    weights = classes.groupBy(F.col("rep").alias("a")).agg(F.max("weight").alias("weight"))
    blocks, cells = open_cells(opened, sized, labels, links)
    searched = keep(search_open(docs, blocks, cells, weights, links), "searched")
    more = searched.filter("kind = 1").select("a", "b")
    if not more.isEmpty():
        labels = components(verified.unionByName(more))
    named = classes.join(labels.select(F.col("node").alias("rep"), "root"), "rep", "left").select("digest", "rep", "weight", F.coalesce("root", "rep").alias("component_id"))
    if links:
        # verified pairs whose blocks meet in a cell are counted there
        of = blocks.select("a", "block")
        at = verified.join(of.select("a", F.col("block").alias("x")), "a", "left").join(of.select(F.col("a").alias("b"), F.col("block").alias("y")), "b", "left")
        apart = at.join(cells.select(F.col("x").alias("cx"), F.col("y").alias("cy")), (F.least("x", "y") == F.col("cx")) & (F.greatest("x", "y") == F.col("cy")), "left_anti").filter("a <> b")
        apart = apart.select("a", "b").unionByName(apart.select(F.col("b").alias("a"), F.col("a").alias("b")))
        alone = apart.join(weights.select(F.col("a").alias("b"), "weight"), "b").select("a", F.col("weight").alias("b"))
        degree = searched.filter("kind = 0").select("a", "b").unionByName(alone).groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("others"))
        named = named.join(degree, "rep", "left").select("digest", "component_id", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"))
    out = named.join(profile.select("digest", "doc_id", "n_shingles"), "digest", "right")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    more_columns = [F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")).alias("n_links")] if links else []
    return out.select("doc_id", "n_shingles", component, *more_columns)
