"""Language identification by hyperdimensional profiles.

Every letter class has a random bipolar vector; a trigram binds its letters'
vectors, permuted by position; a document bundles (sums) the vectors of all its
trigrams; a language's prototype bundles its training documents.  A document is
given the language whose prototype has the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, kept, prepare

CLASSES = 64  # space, a-z, and 37 classes that other letters fall into by code point


@lru_cache(1)
def _letters(dim: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(7)).choice(np.array([-1, 1], dtype=np.int8), (CLASSES, dim))


@lru_cache(1)
def _code_table() -> np.ndarray:
    """Letter class by code point of the basic plane; 0: not a letter."""
    out = np.zeros(65536, dtype=np.uint8)
    for c in range(65536):
        ch = chr(c)
        if ch.isalpha():
            low = ord(ch.lower()[0])
            out[c] = low - 96 if 97 <= low <= 122 else 27 + low % 37
    return out


class Bundler:
    """Trigram vectors on demand: a table row is filled when its trigram first occurs."""

    def __init__(self, dim: int):
        kept("language")  # nothing but room
        self.dim, self.base = dim, _letters(dim)
        self.once, self.twice = np.roll(self.base, 1, axis=1), np.roll(self.base, 2, axis=1)
        self.slot = np.full(CLASSES**3, -1, dtype=np.int32)
        self.rows = np.zeros((4096, dim), dtype=np.float32)
        self.used = 0

    def slots(self, grams: np.ndarray) -> np.ndarray:
        s = self.slot[grams]
        new = grams[s < 0]
        if len(new):
            if self.used > 60_000:  # bounds the table; rows are cheap to make again
                self.slot[:] = -1
                self.used, new = 0, grams
            while self.used + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            a, b, c = new // CLASSES**2, new // CLASSES % CLASSES, new % CLASSES
            self.rows[self.used : self.used + len(new)] = self.twice[a] * self.once[b] * self.base[c]
            self.slot[new] = np.arange(self.used, self.used + len(new))
            self.used += len(new)
            s = self.slot[grams]
        return s

    def vector(self, text: str | None) -> np.ndarray | None:
        """The document's bundle, or None without a letter."""
        if not text:
            return None
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = _code_table()[np.minimum(points, 65535)]
        if (points > 65535).any():
            codes = codes.copy()
            for i in np.flatnonzero(points > 65535):
                codes[i] = 27 + int(points[i]) % 37 if chr(points[i]).isalpha() else 0
        if not codes.any():
            return None
        keep = np.ones(len(codes), dtype=bool)
        keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0)  # runs of other characters are one space
        c = np.concatenate([[0], codes[keep], [0]]).astype(np.int64)
        grams = np.bincount(c[:-2] * CLASSES**2 + c[1:-1] * CLASSES + c[2:], minlength=0)
        ids = np.flatnonzero(grams)
        slots = self.slots(ids)
        return grams[ids].astype(np.float32) @ self.rows[slots]


def held_out(doc_id):
    """Whether a document is held out: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dim: int = 512, max_train: int = 5_000) -> dict[str, np.ndarray]:
    """Unit prototypes by language, from at most about `max_train` labelled rows of each that
    are not held out (the documented bound of the fit; rows are chosen by a hash of the id,
    so a rare language keeps all of its rows).
    """
    prepare(docs.sparkSession)
    usable = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where(F.col("lang").isNotNull() & ~held_out(F.col("id")))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # one row a language
    share = F.lit(1_000_000)
    for lang, n in counts.items():
        if n > max_train:
            share = F.when(F.col("lang") == lang, int(1_000_000 * max_train / n)).otherwise(share)
    usable = usable.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_000)) < share)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hd, sums = Bundler(dim), {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = hd.vector(text)
                if v is not None and (norm := np.linalg.norm(v)) > 0:
                    sums[lang] = sums.get(lang, 0) + v / norm
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.astype(np.float64).tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "v"])

    # One vector a language and task leaves the executors; they are summed there by dimension.
    parts = usable.select("lang", "text").mapInArrow(bundle, "lang string, v array<double>")
    sums = parts.select("lang", F.posexplode("v").alias("d", "x")).groupBy("lang", "d").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for r in sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("d", "x"))).alias("v")).collect():
        v = np.array([x.x for x in r.v])
        out[r.lang] = v / np.linalg.norm(v)
    return dict(sorted(out.items()))


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", dim: int = 512, pred: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """All columns of docs, with lang_pred and score (cosine, 0 to 1); columns of these names are replaced.

    Defined cases: a text that is null or has no letter, and any text when no
    language was learned, is ``und`` with score 0; ties go to the language
    first in the alphabet; text alone decides, so copies and repeated rows get
    equal results, and ids may be null; texts of any length are read whole; an
    empty table gives no row.
    """
    prepare(docs.sparkSession)
    langs, table = list(prototypes), np.array(list(prototypes.values())).reshape(-1, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hd = Bundler(dim)
        for b in batches:
            found, cosines = [], []
            for text in b.column(b.num_columns - 1).to_pylist():
                v = hd.vector(text)
                if v is None or not langs:
                    found.append("und")
                    cosines.append(0.0)
                    continue
                cos = table @ v.astype(np.float64) / max(np.linalg.norm(v), 1e-12)
                k = int(np.argmax(cos))
                found.append(langs[k])
                cosines.append(float(min(1.0, max(0.0, cos[k]))))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.string()), pa.array(cosines, pa.float64())], names)

    kept = [f for f in docs.schema.fields if f.name not in (pred, score_name)]
    names = [*(f.name for f in kept), pred, score_name]
    fields = ", ".join(f"`{n}` {t}" for n, t in [*((f.name, f.dataType.simpleString()) for f in kept), (pred, "string"), (score_name, "double")])
    text = F.col(text_col).cast("string").alias(free_name("text", [*docs.columns, pred, score_name]))
    return docs.select(*(F.col(f"`{f.name}`") for f in kept), text).mapInArrow(run, fields)


#: Cosines below three standard deviations of a chance one say nothing; nor do those of shorter texts.
CHANCE, MIN_CHARS = 3.0, 100


def keep_told(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dim: int = 512) -> DataFrame:
    """docs without the rows in no language that was learned: texts that are ``und``, and texts of
    MIN_CHARS characters and more whose best cosine could be chance.  Where no language was
    learned, only texts without a letter go.  Cases as in ``predict``.
    """
    model = train(docs, id_col, text_col, lang_col, dim)
    if not model:
        return docs.where(F.regexp_like(F.col(text_col), F.lit(r"\p{L}")))
    pred, score = free_name("lang_pred", docs.columns), free_name("score", docs.columns)
    told = predict(docs, model, text_col, dim, pred, score)
    kept = told.where((F.col(pred) != "und") & ((F.col(score) >= CHANCE / dim**0.5) | (F.length(text_col) < MIN_CHARS)))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dim: int = 512) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    model = train(docs, id_col, text_col, lang_col, dim)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return predict(slim, model, dim=dim).select("doc_id", "held_out", "lang_pred", "score")
