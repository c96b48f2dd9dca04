"""Order-preserving packing of token streams into fixed windows.

Documents are tokenised (byte-pair ids, then an end id) and laid end to end in
input order; a dynamic programme chooses the cuts of the stream into windows.
A cut may fall after a document (free), after a sentence (a small penalty) or,
where nothing else is in reach, inside a sentence (a larger one); it pays the
penalties plus the padding.  As the cost of a window is linear in its two ends,
the transition is a sliding-window minimum, kept by a monotone queue.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, prepare
from .textops import buffers, byte_hashes, slices

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Fixed value: the split pattern that ``Pieces`` knows how to apply to bytes.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)


def _byte_classes() -> np.ndarray:
    out = np.full(256, _ODD, dtype=np.uint8)
    out[33:127] = _OTHER
    out[48:58] = _DIGIT
    out[65:91] = out[97:123] = _LETTER
    out[[9, 10, 13, 32]] = _SPACE
    # UTF-8 of U+00C0 to U+017F: lead bytes C3 to C5 and their continuations.
    out[0x80:0xC0] = out[0xC3:0xC6] = _LETTER
    return out


_CLASS = _byte_classes()
#: Two-byte characters of that range that are no plain letters, or fold in their own way.
_STRANGE = {0xC397, 0xC3B7, 0xC4B0, 0xC4B1, 0xC589, 0xC5BF}


class Pieces:
    """Token ids of whole texts, by the pieces that the tokenizer's pattern makes of them.

    The tokenizer never looks across pieces, so a text's ids are those of its
    pieces.  Pieces are cut and hashed on the bytes of many texts at once; a table
    by hash holds the ids of pieces met before, and only new ones are encoded.
    The table is emptied when full: memory is bounded.  Texts with anything
    beyond plain Latin letters, ASCII and simple white space are encoded whole.
    """

    def __init__(self, tokenizer, plain: bool, limit: int = 1_500_000):
        self.tokenizer, self.plain, self.limit = tokenizer, plain, limit
        self._clear()

    def _clear(self) -> None:
        self.keys, self.start, self.many = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, col: pa.Array) -> list[np.ndarray]:
        """Ids of every text of a column; a null is an empty text."""
        data, offsets = buffers(col)
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(col)
        for i, j in slices(offsets):
            part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            odd = self._odd(part, off)
            if not odd.all():
                with np.errstate(over="ignore"):
                    for d, x in enumerate(self._slice(np.where(np.repeat(odd, np.diff(off)), np.uint8(32), part), off)):
                        out[i + d] = x
            if odd.any():
                at = np.flatnonzero(odd)
                for d, x in zip(at, self._encode([part[off[d] : off[d + 1]].tobytes().decode() for d in at])):
                    out[i + d] = x
        return out

    def _odd(self, b: np.ndarray, off: np.ndarray) -> np.ndarray:
        """By text, whether the byte rules do not apply."""
        if not self.plain:
            return np.ones(len(off) - 1, dtype=bool)
        bad = _CLASS[b] == _ODD
        pair = np.flatnonzero((b[:-1] >= 0xC3) & (b[:-1] <= 0xC5)) if len(b) else np.zeros(0, np.int64)
        two = (b[pair].astype(np.int64) << 8) | b[pair + 1]
        bad[pair[np.isin(two, list(_STRANGE))]] = True
        special = np.flatnonzero((b[:-1] == 60) & (b[1:] == 124)) if len(b) else pair  # "<|" may open a special token
        bad[special] = True
        upto = np.concatenate([[0], np.cumsum(bad)])
        return upto[off[1:]] > upto[off[:-1]]

    def _cuts(self, b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the pieces."""
        n = len(b)
        c = _CLASS[b]
        head = np.zeros(n + 1, dtype=bool)
        head[off] = True
        new = np.ones(n, dtype=bool)
        new[1:] = (c[1:] != c[:-1]) | (c[1:] == _DIGIT)
        new |= head[:n]
        # Contractions: a quote that begins a piece takes one or two of the letters after it.
        quote = np.flatnonzero((b == 39) & new)
        low = np.where((b >= 65) & (b <= 90), b + 32, b)
        for shift, words in ((1, (b"s", b"t", b"m", b"d")), (2, (b"re", b"ve", b"ll"))):
            ok = quote[quote + shift < n]
            for w in words:
                hit = ok
                for k, ch in enumerate(w):
                    hit = hit[(low[hit + 1 + k] == ch) & ~head[hit + 1 + k]]
                new[hit + 1] = False
                after = hit + 1 + shift
                after = after[after < n]
                new[after] = True
        start = np.flatnonzero(new & (c != _SPACE))
        ends = np.flatnonzero(new)
        end = np.append(ends, n)[np.searchsorted(ends, start, side="right")]
        return start, end

    def _slice(self, b: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        start, end = self._cuts(b, off)
        keys = byte_hashes(b, start, end, lower=True)
        unique, first, back = np.unique(keys, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, unique), max(len(self.keys) - 1, 0))
        known = self.keys[at] == unique if len(self.keys) else np.zeros(len(unique), dtype=bool)
        if not known.all():
            if len(self.keys) > self.limit:
                self._clear()
                known = np.zeros(len(unique), dtype=bool)
            new = np.flatnonzero(~known)
            raw = b.tobytes()
            encodings = self.tokenizer.encode_batch_fast([raw[s:e].decode() for s, e in zip(start[first[new]].tolist(), end[first[new]].tolist())], add_special_tokens=False)
            flat, many = array("I"), []
            for e in encodings:
                ids = e.ids
                flat.extend(ids)
                many.append(len(ids))
            self._add(unique[new], np.array(many, dtype=np.int64), np.frombuffer(flat, np.uint32))
            at = np.searchsorted(self.keys, unique)
        # Lay the ids of all pieces end to end.
        where = at[back]
        lengths = self.many[where]
        ends = np.cumsum(lengths)
        take = np.repeat(self.start[where] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        ids = self.pool[take].astype("<u4")
        cuts = np.concatenate([[0], ends])[np.searchsorted(start, off)]
        return [ids[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def _add(self, keys: np.ndarray, many: np.ndarray, flat: np.ndarray) -> None:
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        start = self.used + np.cumsum(many) - many
        self.used += len(flat)
        place = np.searchsorted(self.keys, keys)
        self.keys, self.start, self.many = (np.insert(a, place, x) for a, x in ((self.keys, keys), (self.start, start), (self.many, many)))


def _pieces(path: str) -> Pieces:
    """The process's table of a tokenizer file: Python workers serve many tasks."""
    tables = kept("packing")
    if path not in tables:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        splits = [p["pattern"].get("Regex") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if p.get("type") == "Split" and p.get("behavior") == "Removed" and p.get("invert")]
        lowers = any(n.get("type") == "Lowercase" for n in (spec.get("normalizer") or {}).get("normalizers", []))
        tables[path] = Pieces(Tokenizer.from_file(path), splits == [_PATTERN] and lowers)
    return tables[path]


def choose_cuts(bounds: list[int], penalties: list[float], width: int) -> list[int]:
    """Indices into bounds of the cuts of least padding plus penalties.

    ``bounds`` are increasing stream positions from 0, neighbours at most
    `width` apart; the first and last are always cuts.  Window (i, j] costs
    width - (b[j] - b[i]) + penalty[j]: with g(i) = cost(i) + b[i], cost(j) is
    the least g over the bounds within reach, less b[j].
    """
    n = len(bounds)
    cost, back = [0.0] * n, [0] * n
    queue: deque[int] = deque()
    g = [0.0] * n
    for j in range(n):
        if j:
            while bounds[j] - bounds[queue[0]] > width:
                queue.popleft()
            i = queue[0]
            back[j] = i
            cost[j] = g[i] + width - bounds[j] + penalties[j]
        g[j] = cost[j] + bounds[j]
        while queue and g[queue[-1]] > g[j]:
            queue.pop()
        queue.append(j)
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def _bounds(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, width: int, sentence_penalty: float, inner_penalty: float) -> tuple[list[int], list[float]]:
    """Cut positions and penalties: documents, sentences, and every width / 64 tokens within longer sentences."""
    marks = np.union1d(np.flatnonzero(sentence_end[ids]) + 1, doc_ends)
    marks = np.union1d(marks, [0])
    gaps = np.diff(marks)
    step = max(1, width // 64)
    extra = [np.arange(a + step, a + g, step) for a, g in zip(marks[:-1][gaps > step].tolist(), gaps[gaps > step].tolist())]
    inner = np.concatenate(extra) if extra else np.zeros(0, np.int64)
    pos = np.concatenate([marks, inner])
    pen = np.concatenate([np.where(np.isin(marks, doc_ends), 0.0, sentence_penalty), np.full(len(inner), inner_penalty)])
    order = np.argsort(pos, kind="stable")
    return pos[order].tolist(), pen[order].tolist()


def pack(docs: DataFrame, tokenizer_path: str, width: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, block_tokens: int = 1_000_000, sentence_penalty: float = 2.0, inner_penalty: float = 12.0) -> DataFrame:
    """One row per piece: where each document's ids lie.

    Every id lies in exactly one piece; offsets in a sequence are gapless.  The
    programme runs over blocks of about `block_tokens` of a partition's stream;
    the last window of a block is carried into the next, so only the end of a
    partition can be short.  Defined cases: a null or empty text is the end id
    alone; a null id is kept; repeated rows are packed each; an empty table
    gives no row; other columns are not read.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = _pieces(tokenizer_path)
        vocabulary = table.tokenizer.get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 2, dtype=bool)
        ends[[i for t, i in vocabulary.items() if re.fullmatch(r"[^\w\s]*[.!?][^\w\s]*</w>", t)]] = True
        sequence = TaskContext.get().partitionId() << 36
        held: list[list] = []  # [doc_id, ids not yet emitted, ids before them, tokens of the document]
        count = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal sequence, held, count
            if not held:
                return
            ids = np.concatenate([h[1] for h in held])
            doc_ends = np.cumsum([len(h[1]) for h in held])
            bounds, penalties = _bounds(ids, doc_ends, ends, width, sentence_penalty, inner_penalty)
            cuts = [bounds[i] for i in choose_cuts(bounds, penalties, width)]
            if not last:
                cuts.pop()
            out: list[list] = [[] for _ in range(7)]
            d, doc_start = 0, 0
            for a, z in zip(cuts[:-1], cuts[1:]):
                at = a
                while at < z:
                    while doc_ends[d] <= at:
                        doc_start = int(doc_ends[d])
                        d += 1
                    upto = min(z, int(doc_ends[d]))
                    doc_id, _, before, tokens = held[d]
                    for c, x in zip(out, (doc_id, before + at - doc_start, upto - at, zlib.crc32(ids[at:upto].tobytes()), tokens, sequence, at - a)):
                        c.append(x)
                    at = upto
                sequence += 1
            done = cuts[-1]
            rest, start = [], 0
            for h, z in zip(held, doc_ends.tolist()):
                if z > done:
                    skip = max(0, done - start)
                    rest.append([h[0], h[1][skip:], h[2] + skip, h[3]])
                start = z
            held, count = rest, sum(len(h[1]) for h in rest)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), table.ids(b.column(1))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                held.append([doc_id, ids, 0, len(ids)])
                count += len(ids)
                if count >= block_tokens:
                    yield from flush(False)
        yield from flush(True)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
