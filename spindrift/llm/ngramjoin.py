"""Exact Jaccard join on word shingles with signature trees.

1. Shingle sets are hashed and dealt by hash range; a token that occurs in one
   document only can match nothing, so documents with too few shared tokens
   leave the join (an exact bound on the overlap).
2. Rounds of signature trees: documents with a least token in common (under one
   mixing of the tokens a round) are dealt into blocks, each block becomes a
   tree whose nodes hold OR-combined token bitmaps and size ranges, and a dual
   traversal drops node pairs whose maximum possible overlap is too small, or
   whose documents are connected already.  Pairs of leaves that are left are
   verified on the whole sets.  Later rounds take a few documents of each
   component found so far.
3. What rounds can miss is found exactly: partners share one of their rarest
   tokens (the prefix), so documents that meet others of another component at
   such a token are grouped, and blocks of each group are searched against each
   other by the same traversal.

Steps 2 and 3 deal documents into blocks by a few numbers each.  A counted table
of few documents is dealt by one task and told to the sets by broadcast, in place
of a dozen shuffles a round; the trees run in as many tasks as before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, cut, free_name, prepare, release, rest_of, split_groups
from .components import ONE_TASK, connected_components, settled
from .textops import mix, packed, words_of

FAN = 4
#: Bits of a signature by token of the largest set: so many keep the nodes above the leaves selective.
SPREAD, WIDEST = 64, 18
#: One round of trees by mixing of the tokens.
MIXINGS = np.random.Generator(np.random.PCG64(41)).integers(1, 2**63, 4).astype(np.uint64)
#: Parts in which the documents of a token look for their least one; documents of a component that meet others in a round.
SALTS, FEW = 64, 4


def links(inter: int, a: int, b: int, num: int, den: int) -> bool:
    """den * intersection >= num * union, in integers."""
    return inter > 0 and den * inter >= num * (a + b - inter)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


class Node:
    """Signature of a subtree: token bitmap, size range, and what a bitmap can hide."""

    __slots__ = ("bits", "low", "high", "excess", "children", "docs")

    def __init__(self, children: list[Node], docs: list[int], bits: int, low: int, high: int, excess: int):
        self.children, self.docs, self.bits, self.low, self.high, self.excess = children, docs, bits, low, high, excess

    @classmethod
    def over(cls, children: list[Node]) -> Node:
        bits = 0
        for c in children:
            bits |= c.bits
        return cls(children, [d for c in children for d in c.docs], bits, min(c.low for c in children), max(c.high for c in children), max(c.excess for c in children))


class SignatureTree:
    """Trees over sets; ``search`` finds links between unconnected documents.

    ``near``: any keys by which similar sets sort near each other.  ``pruned``
    and ``verified`` count document pairs.
    """

    def __init__(self, sets: list[np.ndarray], groups: list[int], num: int, den: int, near: list | None = None):
        self.sets, self.num, self.den = sets, num, den
        self.near = near or [0] * len(sets)
        self.pruned = self.verified = 0
        self.parent = list(range(len(sets)))
        first: dict[int, int] = {}
        for i, g in enumerate(groups):
            self.parent[i] = first.setdefault(g, i)
        largest = max((len(s) for s in sets), default=1)
        self.width = 1 << max(8, min(WIDEST, (SPREAD * largest - 1).bit_length()))
        self.bits = [self._bitmap(s) for s in sets]
        self.found: list[tuple[int, int]] = []

    def _bitmap(self, s: np.ndarray) -> int:
        flags = np.zeros(self.width, dtype=np.uint8)
        flags[(s & np.uint64(self.width - 1)).astype(np.int64)] = 1
        return int.from_bytes(np.packbits(flags).tobytes(), "little")

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def build(self, docs: list[int]) -> Node | None:
        # Neighbours in the order share a component, or are likely to be similar.
        least: dict[int, tuple] = {}
        for i in docs:
            r, key = self.root(i), (self.near[i], len(self.sets[i]))
            least[r] = min(least.get(r, key), key)
        order = sorted(docs, key=lambda i: (least[self.root(i)], self.root(i), self.near[i], len(self.sets[i])))
        level = [Node([], [i], self.bits[i], len(self.sets[i]), len(self.sets[i]), len(self.sets[i]) - self.bits[i].bit_count()) for i in order]
        while len(level) > 1:
            level = [Node.over(level[k : k + FAN]) for k in range(0, len(level), FAN)]
        return level[0] if level else None

    def _connected(self, a: Node, b: Node) -> bool:
        r = self.root(a.docs[0])
        return all(self.root(i) == r for i in a.docs) and all(self.root(i) == r for i in b.docs)

    def _possible(self, a: Node, b: Node) -> bool:
        if self.num * a.low > self.den * b.high or self.num * b.low > self.den * a.high:
            return False
        most = (a.bits & b.bits).bit_count() + min(a.excess, b.excess)
        return (self.num + self.den) * most >= self.num * (a.low + b.low)

    def search(self, a: Node | None, b: Node | None) -> list[tuple[int, int]]:
        stack = [(a, b)] if a and b else []
        while stack:
            a, b = stack.pop()
            if a is b:
                if a.children and not self._connected(a, a):
                    c = a.children
                    stack += [(c[i], c[j]) for i in range(len(c)) for j in range(i, len(c))][::-1]
                continue
            if not self._possible(a, b):
                self.pruned += len(a.docs) * len(b.docs)
                continue
            if self._connected(a, b):
                continue
            if not a.children and not b.children:
                self._verify(a.docs[0], b.docs[0])
            elif a.children and (len(a.docs) >= len(b.docs) or not b.children):
                stack += [(c, b) for c in a.children]
            else:
                stack += [(a, c) for c in b.children]
        return self.found

    def _verify(self, i: int, j: int) -> None:
        x, y = self.sets[i], self.sets[j]
        self.verified += 1
        n = min(len(x) - (self.bits[i] & ~self.bits[j]).bit_count(), len(y) - (self.bits[j] & ~self.bits[i]).bit_count())
        if links(n, len(x), len(y), self.num, self.den) and links(overlap(x, y), len(x), len(y), self.num, self.den):
            self.parent[self.root(i)] = self.root(j)
            self.found.append((i, j))


def _shared_tokens(docs: DataFrame, k: int, groups: int) -> DataFrame:
    """(doc_id, n, shared) by row: set size and tokens that other documents hold too.

    Documents travel in chunks: a chunk's tokens are dealt by hash range as
    packed 32-bit values of another part of the hash (a chance agreement of two
    tokens only lets a document stay that could go), and the counts meet again
    by chunk.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for i, j, words in words_of(b.column(1), lower=True):
                chunk += 1
                sets = words.shingles(k)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                tokens = np.concatenate(sets)
                part = ((tokens >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)
                owner = np.repeat(np.arange(j - i), sizes)
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(groups + 1))
                small, owner = tokens.astype(np.uint32)[order], owner[order]
                spans = list(zip(cuts[:-1], cuts[1:]))
                # The ids and sizes go with the tokens, to any part.
                yield pa.RecordBatch.from_arrays([
                    pa.array([chunk] * (groups + 1), pa.int64()), pa.array([*range(groups), chunk % groups], pa.int32()), packed([*([ids[:0]] * groups), ids[i:j]], np.int64),
                    packed([*(np.bincount(owner[a:z], minlength=j - i) for a, z in spans), sizes], np.uint32), packed([*(small[a:z] for a, z in spans), small[:0]], np.uint32),
                ], ["chunk", "part", "ids", "counts", "tokens"])

    def count(t: pa.Table) -> pa.Table:
        """Token counts become counts of shared tokens; rows with ids pass."""
        own = pa.compute.equal(pa.compute.binary_length(t["ids"]), 0)
        sized, t = t.filter(pa.compute.invert(own)), t.filter(own)
        counts = [np.frombuffer(x, np.uint32) for x in t["counts"].to_pylist()]
        tokens = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(x, np.uint32) for x in t["tokens"].to_pylist())])
        order = np.argsort(tokens, kind="stable")
        s = tokens[order]
        same = np.zeros(len(tokens) + 1, dtype=bool)
        same[1:-1] = s[1:] == s[:-1]
        flags = np.empty(len(tokens), dtype=np.int64)
        flags[order] = same[:-1] | same[1:]
        upto = np.concatenate([[0], np.cumsum(flags)])
        ends = np.cumsum(np.concatenate([np.zeros(0, np.int64), *counts]).astype(np.int64))
        shared = np.diff(np.concatenate([[0], upto[ends]]))
        cuts = np.cumsum([0, *map(len, counts)])
        out = pa.table({"chunk": t["chunk"], "ids": t["ids"], "counts": packed([shared[a:z] for a, z in zip(cuts[:-1], cuts[1:])], np.uint32)})
        return pa.concat_tables([out, sized.select(["chunk", "ids", "counts"])])

    def meet(t: pa.Table) -> pa.Table:
        ids, sizes, shared = None, None, 0
        for x, c in zip(t["ids"].to_pylist(), t["counts"].to_pylist()):
            c = np.frombuffer(c, np.uint32).astype(np.int64)
            if x:
                ids, sizes = np.frombuffer(x, np.int64), c
            else:
                shared = shared + c
        return pa.table({"doc_id": pa.array(ids), "n": pa.array(sizes), "shared": pa.array(shared)})

    dealt = docs.mapInArrow(deal, "chunk long, part int, ids binary, counts binary, tokens binary")
    parts = dealt.groupBy("part").applyInArrow(count, "chunk long, ids binary, counts binary")
    return parts.groupBy("chunk").applyInArrow(meet, "doc_id long, n long, shared long")


FILTER_BITS = 1 << 25


def _id_filter(ids: DataFrame) -> np.ndarray:
    """Bitmap of FILTER_BITS bits (4 MB, whatever the input) with one bit by id: a superset test."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    bits = ids.select((at / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("bit"))
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for r in bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
        out[r.word] = r.bits
    return out.view(np.uint64)


def _ranked_sets(docs: DataFrame, ids: DataFrame, k: int, groups: int, num: int, den: int) -> DataFrame:
    """(d, n, h, p, m) of the documents that ids name, and of a few others: size, sorted
    tokens, the prefix (the rarest tokens, one of which every partner shares), and
    the least token under each mixing.

    The ids are tested against a bitmap of fixed size where the text is read: no
    text is shuffled.  Tokens are dealt by hash range, counted over these
    documents, and meet again by chunk, as in ``_shared_tokens``.  Documents with
    too few shared tokens leave here too: copies of their own text kept them so
    far.  Rare tokens come first, so passages that many documents hold seldom
    make a pair; tokens that one document holds fill its prefix but pair with nothing.
    """
    bitmap = _id_filter(ids)
    width = np.uint64((1 << 64) // groups + 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for b in batches:
            at = b.column(2).to_numpy(zero_copy_only=False)
            b = b.filter(pa.array((bitmap[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1))
            own = b.column(0).to_numpy(zero_copy_only=False)
            for i, j, words in words_of(b.column(1), lower=True):
                chunk += 1
                sets = words.shingles(k)
                owner = np.repeat(np.arange(j - i, dtype=np.uint32), [len(s) for s in sets])
                tokens = np.concatenate(sets)
                part = (tokens // width).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(groups + 1))
                tokens, owner = tokens[order], owner[order]
                spans = [(a, z) for a, z in zip(cuts[:-1], cuts[1:])]
                some = [g for g, (a, z) in enumerate(spans) if z > a]
                yield pa.RecordBatch.from_arrays([
                    pa.array([chunk] * len(some), pa.int64()), pa.array(some, pa.int32()), packed([own[i:j]] * len(some), np.int64),
                    packed([owner[slice(*spans[g])] for g in some], np.uint32), packed([tokens[slice(*spans[g])] for g in some], np.uint64),
                ], ["chunk", "part", "ids", "owner", "tokens"])

    def count(t: pa.Table) -> pa.Table:
        tokens = [np.frombuffer(x, np.uint64) for x in t["tokens"].to_pylist()]
        cuts = np.cumsum([0, *map(len, tokens)])
        _, back, many = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
        many = np.minimum(many[back], 65535)
        return t.append_column("held", packed([many[a:z] for a, z in zip(cuts[:-1], cuts[1:])], np.uint16))

    def meet(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        ids = np.frombuffer(t["ids"][0].as_buffer(), np.int64)
        owner, tokens, held = (np.concatenate([np.frombuffer(x, kind) for x in t[c].to_pylist()]) for c, kind in (("owner", np.uint32), ("tokens", np.uint64), ("held", np.uint16)))
        # By document; the parts are ranges, so tokens stay sorted.
        order = np.argsort(owner, kind="stable")
        tokens, held = tokens[order], held[order]
        cuts = np.searchsorted(owner[order], np.arange(len(ids) + 1))
        out: list[list] = [[] for _ in range(5)]
        for d, a, z in zip(ids.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
            n, h, own = z - a, held[a:z], tokens[a:z]
            if not n or int((h > 1).sum()) * den < n * num:
                continue
            prefix = np.lexsort((own, h))[: n - -(-num * n // den) + 1]
            with np.errstate(over="ignore"):
                least = [int(mix(own ^ seed).min().view(np.int64)) for seed in MIXINGS]
            for c, x in zip(out, (d, n, own.tobytes(), own[prefix[h[prefix] > 1]].tobytes(), least)):
                c.append(x)
        return pa.table({"d": pa.array(out[0], pa.int64()), "n": pa.array(out[1], pa.int32()), "h": pa.array(out[2], pa.binary()), "p": pa.array(out[3], pa.binary()), "m": pa.array(out[4], pa.list_(pa.int64()))})

    placed = docs.withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)))
    fields = "chunk long, part int, ids binary, owner binary, tokens binary"
    counted = placed.mapInArrow(deal, fields).groupBy("part").applyInArrow(count, f"{fields}, held binary")
    return counted.groupBy("chunk").applyInArrow(meet, "d long, n int, h binary, p binary, m array<long>")


def _prefixes(sets: DataFrame) -> DataFrame:
    """(t, d): the prefix tokens of every set."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = [np.frombuffer(p, np.int64) for p in b.column(1).to_pylist()]
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.repeat(b.column(0).to_numpy(zero_copy_only=False), [len(t) for t in tokens]))], ["t", "d"])

    return sets.select("d", "p").mapInArrow(emit, "t long, d long")


def _solve(t: pa.Table, one: list[int], two: list[int] | None, num: int, den: int) -> pa.Table:
    """Links (u, v) that trees over the rows `one`, or `one` against `two`, find."""
    ids = t["d"].to_pylist()
    tree = SignatureTree([np.frombuffer(h, np.uint64) for h in t["h"].to_pylist()], t["component"].to_pylist(), num, den, list(map(tuple, t["m"].to_pylist())))
    a = tree.build(one)
    found = tree.search(a, a if two is None else tree.build(two))
    return pa.table({"u": pa.array([ids[i] for i, _ in found], pa.int64()), "v": pa.array([ids[j] for _, j in found], pa.int64())})


def _columns(batches: Iterator[pa.RecordBatch], n: int) -> list[np.ndarray]:
    """The first n columns of all batches."""
    got = [[c.to_numpy(zero_copy_only=False) for c in b.columns[:n]] for b in batches]
    return [np.concatenate([np.zeros(0, np.int64), *(g[i] for g in got)]) for i in range(n)]


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first position, length) of the runs of equal keys."""
    n = len(keys[0])
    new = np.ones(n, dtype=bool)
    if n:
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, n))


def _parts(d: np.ndarray, sizes: np.ndarray, block: int) -> np.ndarray:
    """The part of its group that each document falls in, by a hash: about `block` a part; sizes by document."""
    with np.errstate(over="ignore"):
        return (mix(d.astype(np.int64).view(np.uint64)) % (-(-sizes // block)).astype(np.uint64)).astype(np.int64)


def _deal_few(block: int):
    """What ``_round`` deals, by one task: d, component, token to d, component, token, s."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, component, token = _columns(batches, 3)
        order = np.lexsort((d, component, token))
        d, component, token = d[order], component[order], token[order]
        first, many = _runs(token, component)
        rank = np.arange(len(d)) - np.repeat(first, many)
        first, many = _runs(token)
        met = np.repeat(component[first] != component[first + many - 1], many) & (rank < FEW)
        d, component, token = d[met], component[met], token[met]
        many = _runs(token)[1]
        s = _parts(d, np.repeat(many, many), block)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (d, component, token, s)], ["d", "component", "token", "s"])

    return deal


def _round(slim: DataFrame, sets: DataFrame, k: int, num: int, den: int, block: int, few: bool) -> DataFrame:
    """Links among documents with the same least token under mixing k; slim: d, component, m.

    Of every component a few documents meet the others at a token (what this
    leaves out, ``_tree_links`` finds), and tokens of one component are left out.
    """
    def solve(t: pa.Table) -> pa.Table:
        return _solve(t, list(range(len(t))), None, num, den)

    at = slim.select("d", "component", F.get("m", F.lit(k)).alias("token"))
    if few:
        dealt = at.coalesce(1).mapInArrow(_deal_few(block), "d long, component long, token long, s long")
        return sets.join(F.broadcast(dealt), "d").groupBy("token", "s").applyInArrow(solve, "u long, v long")
    open_tokens = at.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("token")
    rank = F.row_number().over(Window.partitionBy("token", "component").orderBy("d"))
    met = at.join(open_tokens, "token", "left_semi").withColumn("r", rank).where(F.col("r") <= FEW).drop("r")
    dealt = split_groups(met, ["token"], "d", block, "s")
    return dealt.join(sets, "d").groupBy("token", "s").applyInArrow(solve, "u long, v long")


def _tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) from the first document of a token to its others; batches: t, d."""
    t, d = _columns(batches, 2)
    order = np.argsort(t, kind="stable")
    d = d[order]
    first, many = _runs(t[order])
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(d[first], many), pa.int64()), pa.array(d, pa.int64())], ["u", "v"])


def _star_groups(tokens: DataFrame) -> DataFrame:
    """(d, group): documents that tokens connect; tokens: t, d.

    Documents are tied to the least one of their part of a token, and those to
    the least of all, so no task holds all documents of a token.
    """
    parts = tokens.withColumn("salt", F.pmod(F.xxhash64("d"), F.lit(SALTS)))
    tied = cut(parts.withColumn("u", F.min("d").over(Window.partitionBy("t", "salt"))).select("t", "u", "d"))
    heads = tied.select("t", "u").distinct().withColumn("top", F.min("u").over(Window.partitionBy("t")))  # at most SALTS a token
    edges = tied.select("u", F.col("d").alias("v")).unionByName(heads.select(F.col("top").alias("u"), F.col("u").alias("v"))).where("u <> v")
    return connected_components(edges).select(F.col("node").alias("d"), F.col("component").alias("group"))


def _with_component(slim: DataFrame, linked: DataFrame, few: bool) -> DataFrame:
    """slim with the component that links give each document; its own id without one."""
    # A tree's links are fewer than its documents: so are a round's where documents are few.
    found = (settled(linked) if few else connected_components(linked)).select(F.col("node").alias("d"), F.col("component").alias("found"))
    if few:
        found, slim = F.broadcast(found), slim.coalesce(1)
    return cut(slim.drop("component").join(found, "d", "left").withColumn("component", F.coalesce("found", "d")).drop("found"))


def _place_few(width: float, block: int):
    """The blocks of ``_tree_links``, by one task: group, d, component, n to d, component, b, group, c, numbers b from 0."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, d, component, n = _columns(batches, 4)
        c = np.floor(np.log(np.maximum(n, 1)) / width).astype(np.int64)
        order = np.lexsort((component, c, group))
        group, d, component, c = group[order], d[order], component[order], c[order]
        many = _runs(group, c, component)[1]
        large = np.repeat(many, many) > block
        order = np.lexsort((np.where(large, component, 0), large, c, group))
        group, d, component, c, large = group[order], d[order], component[order], c[order], large[order]
        own = np.where(large, component, 0)
        many = _runs(group, c, large, own)[1]
        s = _parts(d, np.repeat(many, many), block)
        order = np.lexsort((s, own, large, c, group))
        group, d, component, c, large, own, s = (x[order] for x in (group, d, component, c, large, own, s))
        many = _runs(group, c, large, own, s)[1]
        b = np.repeat(np.arange(len(many)), many)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (d, component, b, group, c)], ["d", "component", "b", "group", "c"])

    return place


def _near_few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(b, one, two): the pairs of blocks that can hold a link, a row by block; batches: component, b, group, c."""
    component, b, group, c = _columns(batches, 4)
    order = np.lexsort((component, b))
    component, b, group, c = component[order], b[order], group[order], c[order]
    first, many = _runs(b)
    low, high, group, c = component[first], component[first + many - 1], group[first], c[first]
    for i in range(len(first)):
        # Blocks of the class and of the next one follow each other.
        j = np.arange(i, np.searchsorted(group, group[i], side="right"))
        j = j[c[j] <= c[i] + 1]
        j = j[np.minimum(low[j], low[i]) != np.maximum(high[j], high[i])]
        both = np.concatenate([j, np.full(int((j != i).sum()), i)])
        two = np.concatenate([j, j[j != i]])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (both, np.full(len(two), i), two)], ["b", "one", "two"])


def _tree_links_few(open_docs: DataFrame, sets: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """``_tree_links`` of few documents: one task makes the blocks and pairs them."""

    def solve(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        b = t["b"].to_numpy()
        one, two = (np.flatnonzero(b == k.as_py()).tolist() for k in key)
        return _solve(t, one, None if key[0] == key[1] else two, num, den)

    placed = open_docs.select("group", "d", "component", "n").coalesce(1).mapInArrow(_place_few(_class_width(num, den), block), "d long, component long, b long, group long, c long")
    placed = cut(placed)
    near = placed.select("component", "b", "group", "c").mapInArrow(_near_few, "b long, one long, two long")
    rows = sets.join(F.broadcast(placed.select("d", "component", "b")), "d").join(F.broadcast(near), "b")
    return rows.groupBy("one", "two").applyInArrow(solve, "u long, v long")


def _class_width(num: int, den: int) -> float:
    """Logarithm of the ratio of sizes that a link allows."""
    return float(np.log(den / num)) if num < den else 1e-9


def _tree_links(open_docs: DataFrame, sets: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """Links (u, v) between unconnected documents of each group; open_docs: group, d, component, n.

    A group is split into blocks of about `block` documents by size class, where
    a large component has blocks of its own; only blocks of the same or
    neighbouring classes can hold a link, and none lies between blocks of one
    component.
    """
    width = _class_width(num, den)
    classed = open_docs.withColumn("c", F.floor(F.log("n") / width).cast("int"))
    crowded = split_groups(classed, ["group", "c", "component"], "d", block, "s")
    owned = crowded.withColumn("own", F.when(F.col("s_parts") > 1, F.col("component")).otherwise(F.lit(-1))).drop("s", "s_parts")
    placed = cut(split_groups(owned, ["group", "c", "own"], "d", block, "s").drop("s_parts"))
    # Metadata only: one row a block.
    blocks = placed.groupBy("group", "c", "own", "s").agg(F.count("*").alias("many"), F.min("component").alias("a"), F.max("component").alias("b"))
    other = blocks.select("group", F.col("c").alias("c2"), F.col("own").alias("own2"), F.col("s").alias("s2"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    near = blocks.join(other, "group").where("c2 = c + 1 or (c2 = c and (own2 > own or (own2 = own and s2 >= s)))").where("least(a, a2) <> greatest(b, b2)")
    ends = F.array_distinct(F.array(F.struct("c", "own", "s"), F.struct(F.col("c2").alias("c"), F.col("own2").alias("own"), F.col("s2").alias("s"))))
    near = near.select("group", F.struct("c", "own", "s", "c2", "own2", "s2").alias("pair"), F.explode(ends).alias("e")).select("group", "pair", "e.c", "e.own", "e.s")

    def solve(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        pair = key[1].as_py()
        at = list(zip(t["c"].to_pylist(), t["own"].to_pylist(), t["s"].to_pylist()))
        one = [i for i, x in enumerate(at) if x == (pair["c"], pair["own"], pair["s"])]
        two = [i for i, x in enumerate(at) if x == (pair["c2"], pair["own2"], pair["s2"])]
        return _solve(t, one, None if one == two else two, num, den)

    return placed.join(near, ["group", "c", "own", "s"]).join(sets, "d").groupBy("group", "pair").applyInArrow(solve, "u long, v long")


def _components(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int, block: int, group_mb: float, one_task: int) -> DataFrame:
    """(doc_id, own, n_shingles, component_id) of every row; own: the text's hash."""
    prepare(docs.sparkSession)
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("own"))
    rows = cut(base.select("doc_id", "own", F.md5("text").alias("key"), F.octet_length("text").alias("size")))
    groups = int(max(8, round((rows.agg(F.sum("size")).first()[0] or 0) / (group_mb * 1e6))))
    # An id with several texts names the first; the others get names of their own (below all ids).
    odd = rows.where("doc_id is not null and key is not null").groupBy("doc_id").agg(F.min("own").alias("a"), F.max("own").alias("b")).where("a <> b").select("doc_id", "a")
    odd = cut(odd)
    named = F.lit(-(1 << 62)) - F.pmod(F.xxhash64("doc_id", "own"), F.lit(1 << 61))
    if not odd.isEmpty():
        base, rows = (x.join(odd, "doc_id", "left").withColumn("d", F.when(F.col("own") != F.col("a"), named).otherwise(F.col("doc_id"))).drop("a") for x in (base, rows))
    else:
        base, rows = (x.withColumn("d", F.col("doc_id")) for x in (base, rows))
    # Copies of a text are one document, named by the least id.
    classes = rows.where("d is not null and key is not null").groupBy("key").agg(F.min("d").alias("rep"))
    texts = base.where("d is not null").select(F.col("d").alias("doc_id"), "text")
    shared = cut(_shared_tokens(texts, k, groups))
    live = shared.where((F.col("n") > 0) & (F.col("shared") * den >= F.col("n") * num)).select("doc_id")
    live = cut(live.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"))
    tokens_left, many = shared.join(live, "doc_id", "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    few = many <= one_task
    ranked = cut(_ranked_sets(texts, live, k, int(max(4, round(tokens_left / 2_500_000))), num, den))
    release(docs.sparkSession)  # the tokens dealt
    sets = ranked.select("d", "h", "m")
    slim = ranked.select("d", "n", "m", F.col("d").alias("component"))
    if few:
        slim = cut(slim)  # without the sets
    linked = None
    for i in range(len(MIXINGS)):
        new = cut(_round(slim, sets, i, num, den, block, few))
        linked = new if linked is None else linked.unionByName(new)
        slim = _with_component(slim, linked, few)
    release(docs.sparkSession)
    # What the rounds left open: tokens of a prefix at which components meet.
    told = slim.select("d", "component")
    tokens = _prefixes(ranked).join(F.broadcast(told) if few else told, "d")
    still = tokens.groupBy("t").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("t")
    met = tokens.join(still, "t", "left_semi").select("t", "d")
    if few:
        met = cut(met)
        at = settled(met.coalesce(1).mapInArrow(_tied, "u long, v long")).select(F.col("node").alias("d"), F.col("component").alias("group")) if met.count() <= one_task else _star_groups(met)
        links_left = cut(_tree_links_few(slim.drop("m").join(F.broadcast(at), "d"), sets, num, den, block))
    else:
        links_left = _tree_links(slim.drop("m").join(_star_groups(met), "d"), sets, num, den, block)
    linked = linked.unionByName(links_left)
    found = settled(linked) if few and links_left.count() <= one_task else connected_components(linked)
    rep_of = rows.join(classes, "key", "left").select("doc_id", "own", "d", "rep")
    out = rep_of.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep", "d"))
    out = out.join(shared.groupBy(F.col("doc_id").alias("d")).agg(F.max("n").alias("n_shingles")), "d", "left")
    n = F.coalesce("n_shingles", F.lit(0).cast("long"))
    out = out.withColumn("n_shingles", n).withColumn("component", F.when(n == 0, F.col("d")).otherwise(F.col("component")))
    if not odd.isEmpty():
        # Names that are no ids give way to the least id of their component.
        least = cut(out).groupBy("component").agg(F.min("doc_id").alias("least"))
        out = out.join(least, "component", "left").withColumn("component", F.coalesce("least", "component"))
    return out.select("doc_id", "own", "n_shingles", F.col("component").alias("component_id"))


def shingle_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 75, den: int = 100, block: int = 512, group_mb: float = 14.0, one_task: int = ONE_TASK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Two documents link when den * intersection >= num * union of their sets of
    distinct k-word shingles (A-Z in lower case; fewer words: the sequence as
    one).  Defined cases: null, empty and wordless texts have the empty set and
    are components of their own; repeated rows get equal results; rows of one id
    with different texts are judged each by its own text; a null id links with
    nothing and its component is null; texts of any length are read whole; a
    similarity of exactly num / den links; an empty table gives no row; other
    columns are not read.  So many documents as `one_task` are dealt by one task.
    """
    return _components(docs, id_col, text_col, k, num, den, block, group_mb, one_task).drop("own")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 75, den: int = 100, block: int = 512, group_mb: float = 14.0, one_task: int = ONE_TASK) -> DataFrame:
    """One row of each component: that of its least id; of repeated rows of an id and text, any one.

    Rows with a null id stay.  Cases as in ``shingle_components``.
    """
    own, gone = free_name("own", docs.columns), free_name("gone", docs.columns)
    found = cut(_components(docs, id_col, text_col, k, num, den, block, group_mb, one_task).where("doc_id is not null"))
    told = found.groupBy(F.col("doc_id"), F.col("own")).agg(F.count("*").alias("many"), F.min("component_id").alias("component_id"))
    told = told.where("component_id <> doc_id or many > 1").select(F.col("doc_id").alias(gone), F.col("own").alias(own), (F.col("component_id") == F.col("doc_id")).alias("stays"))
    away, repeated = told.where("not stays").drop("stays"), told.where("stays").drop("stays")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    left = rest_of(docs.withColumns({gone: F.col(id_col).cast("long"), own: F.xxhash64(F.col(text_col).cast("string"))}), away, gone, own)
    if repeated.isEmpty():
        return left.select(*columns)
    sure, maybe = apart(left, repeated, gone, own)
    once = maybe.join(repeated, [gone, own], "left_semi").dropDuplicates([gone, own])
    return sure.unionByName(maybe.join(repeated, [gone, own], "left_anti")).unionByName(once).select(*columns)
