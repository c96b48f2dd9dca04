"""Substring dedup with prefix-partitioned suffix trees.

Every suffix of a document that is at least `window` words long is a leaf of a
suffix tree cut at that depth.  Suffixes are dealt into memory-sized groups by a
prefix whose length varies: one word, or 2, 4, 8 words or the whole window where
shorter prefixes are too common (prefix frequencies come from a bounded sample;
every suffix is dealt).  Each group builds its subtree over the suffixes in path
order: inner nodes at the depths of ``PATH`` and at `window`, edges labelled by
fingerprints of their words in place of the words.  The deep inner nodes, at
depth `window` with leaves of several documents, are the repeats; nodes of
neighbouring suffixes chain into maximal repeats, and words they cover in later
documents go.

Equal windows of one chunk of texts meet before anything is dealt, so a window
that very many documents hold reaches its group once a chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, groups_for, may_hold, prepare
from .textops import Words, mix, packed, words_of

LEVELS = (1, 2, 4, 8)
#: Depths, between the prefix and the window, at which paths may part: one byte of the path each.
PATH = (16, 32)


def _prefix(words: Words, heavy: dict[int, np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window labels, prefix hashes, whether a whole window starts there)."""
    label, ok = words.windows(window)
    prefix = words.hash.copy()
    todo = np.arange(len(prefix))
    for level, longer in zip(LEVELS, (*LEVELS[1:], window)):
        if not len(heavy.get(level, ())) or not len(todo):
            break
        hit = heavy[level][np.minimum(np.searchsorted(heavy[level], prefix[todo]), len(heavy[level]) - 1)] == prefix[todo]
        todo = todo[hit]
        if len(todo):
            prefix[todo] = (label if longer == window else words.windows(longer)[0])[todo]
    return label, prefix, ok


def _heavy_prefixes(docs: DataFrame, groups: int, sample_docs: int) -> dict[int, np.ndarray]:
    """By length, the prefixes that hold more than a quarter of a group's share in a sample.

    At most 4 * groups a length can; only they come to the driver.
    """
    n = docs.select("doc_id").count()
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample_docs / max(n, 1))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, words in words_of(b.column(1), lower=False):
                for level in LEVELS:
                    h = words.hash if level == 1 else words.windows(level)[0]
                    if not len(h):
                        continue
                    keys, counts = np.unique(h, return_counts=True)
                    some = counts * (16 * groups) > len(h)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(some.sum() + 1, level), pa.int32()), pa.array(np.append(keys[some].view(np.int64), 0)), pa.array(np.append(counts[some], 0)), pa.array(np.append(np.zeros(some.sum(), np.int64), len(h)))], ["level", "key", "n", "all"])

    sums = sample.mapInArrow(count, "level int, key long, n long, all long").groupBy("level", "key").agg(F.sum("n").alias("n"), F.sum("all").alias("all"))
    sums = cut(sums)
    total = sums.agg(F.max("all")).first()[0] or 0
    rows = sums.where(F.col("n") * (4 * groups) > total).select("level", "key").collect()
    return {level: np.sort(np.array([r.key for r in rows if r.level == level], dtype=np.int64).view(np.uint64)) for level in LEVELS}


def _path(words: Words) -> np.ndarray:
    """The way of each suffix down the inner nodes: one byte a depth of PATH."""
    way = np.zeros(len(words.hash), dtype=np.uint16)
    for depth in PATH:
        way = (way << np.uint16(8)) | (words.windows(depth)[0] & np.uint64(255)).astype(np.uint16)
    return way


class Subtree:
    """The suffix tree of one group: suffixes in path order, and inner nodes as ranges of them.

    ``nodes``: by depth (0: the group's prefix), where each node's range begins;
    ranges of a depth follow each other, and every range lies in one of the
    depth above, its parent.
    """

    def __init__(self, way: np.ndarray, labels: np.ndarray):
        self.order = np.lexsort((labels, way))
        w, s = way[self.order], labels[self.order]
        self.nodes = [np.zeros(min(1, len(w)), np.int64)]
        part = np.zeros(len(w), dtype=bool)
        part[:1] = True
        for k in range(len(PATH)):
            byte = w >> np.uint16(8 * (len(PATH) - 1 - k))
            part[1:] |= byte[1:] != byte[:-1]
            self.nodes.append(np.flatnonzero(part))
        part[1:] |= s[1:] != s[:-1]
        self.nodes.append(np.flatnonzero(part))

    def least(self, docs: np.ndarray) -> np.ndarray:
        """By leaf, the least document below its deepest inner node."""
        out = np.empty(len(docs), dtype=np.int64)
        deep = self.nodes[-1]
        if len(deep):
            own = docs[self.order]
            out[self.order] = np.repeat(np.minimum.reduceat(own, deep), np.diff(np.append(deep, len(own))))
        return out


def _parts(prefix: np.ndarray, groups: int) -> np.ndarray:
    """The group of each suffix."""
    return (mix(prefix) % np.uint64(groups)).astype(np.int64)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return start, np.append(start[1:], len(keys))


def _known_earlier(labels: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether the same window occurs in a smaller document of the same chunk."""
    order = np.argsort(labels, kind="stable")
    start, end = _runs(labels[order])
    out = np.zeros(len(labels), dtype=bool)
    if len(start):
        out[order] = docs[order] > np.repeat(np.minimum.reduceat(docs[order], start), end - start)
    return out


def _maximal(covered: np.ndarray) -> list[tuple[int, int]]:
    """Maximal repeats of a document: (first word, words) of each run of words that repeats cover."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return [(int(a), int(z - a)) for a, z in zip(edges[::2], edges[1::2])]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, group_mb: float = 14.0, sample_docs: int = 2000) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept, repeats) of every row;
    repeats: (start, length) in words of the maximal runs that were removed.

    A word goes if it lies in a window of `window` words whose sequence also
    starts in a document with a smaller id.  Defined cases: null, empty and
    short texts lose nothing; of equal texts the least id keeps its words; rows
    that repeat an id do not count against each other, whether their texts agree
    or not; a null id neither loses words nor counts against others; texts of
    any length are read whole; an empty table gives no row; other columns are
    not read.
    """
    prepare(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("own"))
    known = base.where("doc_id is not null and text is not null")
    groups = groups_for(base, "text", group_mb)
    heavy = _heavy_prefixes(known, groups, sample_docs)
    if window <= max(PATH):
        raise ValueError(f"windows have more than {max(PATH)} words")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for b in batches:
            ids, own = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
            for i, j, words in words_of(b.column(1), lower=False):
                label, prefix, ok = _prefix(words, heavy, window)
                at = np.flatnonzero(ok)
                if not len(at):
                    continue
                chunk += 1
                owner = np.searchsorted(words.first[:-1], at, side="right") - 1
                sure = _known_earlier(label[at], ids[i:j][owner])
                part = _parts(prefix[at], groups)
                order = np.argsort(part, kind="stable")
                part, owner, sure, at = part[order], owner[order], sure[order], at[order]
                way, labels = _path(words)[at], label[at]
                rows: list[list] = [[] for _ in range(6)]
                for a, z in zip(*_runs(part)):
                    s = sure[a:z]
                    first, end = _runs(owner[a:z])
                    many = np.diff(np.concatenate([[0], np.cumsum(~s)])[np.append(first, end[-1])])
                    marks = np.concatenate([np.packbits(s[x:y]) for x, y in zip(first, end)]) if s.any() else np.zeros(0, np.uint8)
                    for c, x in zip(rows, (int(part[a]), np.stack([owner[a:z][first], many, end - first]).astype(np.uint32), ids[i:j][owner[a:z][first]], labels[a:z][~s], way[a:z][~s], marks)):
                        c.append(x)
                # The last row of a chunk names its documents; it goes to any group.
                n = len(rows[0])
                yield pa.RecordBatch.from_arrays([
                    pa.array([chunk] * (n + 1), pa.int64()), pa.array([*rows[0], chunk % groups], pa.int32()), packed([*rows[1], np.zeros(0)], np.uint32), packed([*rows[2], ids[i:j]], np.int64),
                    packed([*rows[3], own[i:j].view(np.uint64)], np.uint64), packed([*rows[4], np.zeros(0)], np.uint16), packed([*rows[5], np.zeros(0)], np.uint8),
                ], ["chunk", "part", "who", "ids", "labels", "way", "sure"])

    def solve(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        """Bits over each document's suffixes of the group that a smaller document holds."""
        who = [np.frombuffer(x, np.uint32).reshape(3, -1).astype(np.int64) for x in t["who"].to_pylist()]
        ids = [np.frombuffer(x, np.int64) for x in t["ids"].to_pylist()]
        names = [not w.shape[1] for w in who]
        read = lambda c, kind: [np.frombuffer(x, kind) for x, name in zip(t[c].to_pylist(), names) if not name]
        labels, way, sure = read("labels", np.uint64), read("way", np.uint16), read("sure", np.uint8)
        dealt = [(c, w, d) for c, w, d, name in zip(t["chunk"].to_pylist(), who, ids, names) if not name]
        none = np.zeros(0, np.int64)
        docs_of = np.concatenate([none, *(np.repeat(d, w[1]) for _, w, d in dealt)])
        tree = Subtree(np.concatenate([none.astype(np.uint16), *way]), np.concatenate([none.astype(np.uint64), *labels]))
        later = docs_of > tree.least(docs_of)
        out: list[list] = [[] for _ in range(5)]
        end = 0
        for (chunk, w, _), marks in zip(dealt, sure):
            docs_found, bits, place = [], [], 0
            for d, many, whole in w.T.tolist():
                flags = np.zeros(whole, dtype=bool)
                if len(marks):
                    flags = np.unpackbits(marks[place : place + (whole + 7) // 8], count=whole).astype(bool)
                    place += (whole + 7) // 8
                flags[~flags] = later[end : end + many]
                end += many
                if flags.any():
                    docs_found.append(d)
                    bits.append(np.packbits(flags).tobytes())
            if docs_found:
                for c, x in zip(out, (chunk, np.array(docs_found, np.int64).tobytes(), bits, key[0].as_py(), b"")):
                    c.append(x)
        for c, d, x, name in zip(t["chunk"].to_pylist(), t["ids"].to_pylist(), t["labels"].to_pylist(), names):
            if name:
                for o, y in zip(out, (c, d, [], -1, x)):
                    o.append(y)
        return pa.table({"chunk": pa.array(out[0], pa.int64()), "ids": pa.array(out[1], pa.binary()), "bits": pa.array(out[2], pa.list_(pa.binary())), "part": pa.array(out[3], pa.int32()), "own": pa.array(out[4], pa.binary())})

    def meet(t: pa.Table) -> pa.Table:
        """The marks of a chunk's documents from all groups, one row a document."""
        found: dict[int, list[dict]] = {}
        names = texts = np.zeros(0, np.int64)
        for part, ids, bits, own in zip(t["part"].to_pylist(), t["ids"].to_pylist(), t["bits"].to_pylist(), t["own"].to_pylist()):
            if part < 0:
                names, texts = np.frombuffer(ids, np.int64), np.frombuffer(own, np.int64)
                continue
            for d, x in zip(np.frombuffer(ids, np.int64).tolist(), bits):
                found.setdefault(d, []).append({"part": part, "bits": x})
        at = np.array(list(found), dtype=np.int64)
        return pa.table({"doc_id": pa.array(names[at], pa.int64()), "own": pa.array(texts[at], pa.int64()), "flags": pa.array(list(found.values()), pa.list_(pa.struct([("part", pa.int32()), ("bits", pa.binary())])))})

    dealt = known.mapInArrow(deal, "chunk long, part int, who binary, ids binary, labels binary, way binary, sure binary")
    flagged = dealt.groupBy("part").applyInArrow(solve, "chunk long, ids binary, bits array<binary>, part int, own binary")
    flagged = flagged.groupBy("chunk").applyInArrow(meet, "doc_id long, own long, flags array<struct<part:int,bits:binary>>")
    # Rows that agree in id and text have the same marks.
    flagged = cut(flagged.dropDuplicates(["doc_id", "own"]))

    def erase(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b.column(1)
            flags = b.column(2).to_pylist()
            n_words, removed, digests, kept_texts, repeats = [], [], [], [], []
            for i, j, words in words_of(data, lower=False):
                gone = np.zeros(len(words.hash) + 1, dtype=np.int64)
                if any(flags[i:j]):
                    _, prefix, ok = _prefix(words, heavy, window)
                    for d in range(j - i):
                        if not flags[i + d]:
                            continue
                        at = np.flatnonzero(ok[words.first[d] : words.first[d + 1]]) + int(words.first[d])
                        part = _parts(prefix[at], groups)
                        order = np.argsort(part, kind="stable")
                        part, at = part[order], at[order]
                        for x in flags[i + d]:
                            lo, hi = np.searchsorted(part, [x["part"], x["part"] + 1])
                            hit = at[lo:hi][np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=hi - lo).astype(bool)]
                            np.add.at(gone, hit, 1)
                            np.add.at(gone, hit + window, -1)
                covered = np.cumsum(gone)[:-1] > 0
                for d in range(j - i):
                    a, z = int(words.first[d]), int(words.first[d + 1])
                    lost = covered[a:z]
                    text = data[i + d].as_py() or ""
                    if z == a:
                        kept = ""
                    else:
                        raw, shift = text.encode(), int(words.offsets[d])
                        kept = b" ".join(raw[s:e] for s, e in zip((words.start[a:z][~lost] - shift).tolist(), (words.end[a:z][~lost] - shift).tolist())).decode()
                    n_words.append(z - a)
                    removed.append(int(lost.sum()))
                    repeats.append([{"start": s, "length": n} for s, n in _maximal(lost)] if removed[-1] else [])
                    kept_texts.append(kept)
                    digests.append(hashlib.sha256(kept.encode()).hexdigest())
            spans = pa.array(repeats, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept_texts, pa.string()), spans], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "repeats"])

    # Only texts that may be marked are shuffled to their marks.
    maybe = may_hold(base, flagged, "own", "maybe")
    marked = maybe.where("maybe").join(flagged, ["doc_id", "own"], "left").select("doc_id", "text", "flags")
    others = maybe.where("not maybe").select("doc_id", "text", F.lit(None).cast("array<struct<part:int,bits:binary>>").alias("flags"))
    return marked.unionByName(others).mapInArrow(erase, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, repeats array<struct<start:long,length:long>>")
