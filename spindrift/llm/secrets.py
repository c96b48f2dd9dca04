"""Secret scans through a trigram inverted index.

A Boolean trigram query is derived from each rule's parsed pattern
(``trigrams.query_of``).  Documents are indexed in segments (one Arrow batch
each): one pass over the bytes gives the postings of all trigrams that some
query names; each query intersects and unites postings, and only its candidates
are verified by the pattern.  A rule whose pattern has no mandatory trigram (bare
hex digits) scans every document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .textops import buffers
from .trigrams import TrigramIndex, query_of


def _either(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """Spans of a pattern whose group has at least so many characters."""

    kind: str
    pattern: re.Pattern
    group: int = 0
    least: int = 0

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        for m in self.pattern.finditer(text):
            if len(m[self.group]) >= self.least:
                yield m.span()


# The three base kinds, then the kinds the method adds.
BASE = (
    Rule("assign", re.compile("(?:" + "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")]) + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 1, 8),
    Rule("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
    # A greedy run of 32 and more is the whole run, so shorter ones need not be found to be dropped.
    Rule("hex", re.compile("[0-9a-f]{32,}"), 0, 32),
)
ADDED = (
    Rule("pem", re.compile("-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")),
    Rule("github", re.compile("gh[pousr]_[A-Za-z0-9]{36,}")),
    Rule("slack", re.compile("xox[abprs]-[A-Za-z0-9-]{10,}")),
    Rule("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    Rule("google", re.compile("AIza[A-Za-z0-9_-]{35}")),
)


class Scanner:
    """Rules with their queries, and the index that batches are put into."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.queries = [query_of(r.pattern) for r in rules]
        self.index = TrigramIndex(self.queries)

    def scan(self, col: pa.Array) -> list[list[tuple[int, int, int]]]:
        """By text: (start, rule number, end), sorted."""
        self.index.fill(*buffers(col))
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(col))]
        texts: dict[int, str] = {}
        for k, (rule, query) in enumerate(zip(self.rules, self.queries)):
            for i in self.index.ask(query).tolist():
                if i not in texts:
                    texts[i] = col[i].as_py() or ""
                found[i] += [(a, k, z) for a, z in rule.spans(texts[i])]
        for f in found:
            f.sort()
        return found


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, a digest of their spans, all spans.

    A span is ``kind:start:end`` in code points, end exclusive, ordered by start
    and then kind.  Defined cases: a null text is empty (no spans, the digest of
    the empty string); a null id is kept; repeated rows give repeated rows; spans
    that start together are ordered by kind, as listed; texts of any length are
    read whole; an empty table gives no row; other columns are not read.
    """
    prepare(docs.sparkSession)
    rules = BASE + ADDED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for b in batches:
            counts: list[list[int]] = [[], [], []]
            digests, spans = [], []
            for f in scanner.scan(b.column(1)):
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in f))
                digests.append(hashlib.sha256(",".join(f"{rules[k].kind}:{a}:{z}" for a, k, z in f if k < 3).encode()).hexdigest())
                spans.append(",".join(f"{rules[k].kind}:{a}:{z}" for a, k, z in f))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
