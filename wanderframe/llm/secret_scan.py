"""Secret scans: a trigram inverted index picks the documents on which a rule's regex is worth running.

From each regex a Boolean query over trigrams is derived that every match satisfies. For a block of documents
the postings of just the queries' trigrams are built from the bytes in numpy, intersected and united by
the query, and the regex verifies the candidates. A rule whose regex forces no trigram scans all documents.
Blocks are bounded in bytes, so memory does not depend on the input; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product
from re import _parser as regex_tree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, tidied

#: Bytes of text that are indexed at a time (a longer text is a block of its own).
BLOCK_BYTES = 4 << 20
#: Most strings that a part of a regex is spelled out to, and most characters of a class.
MOST_STRINGS, MOST_CHARS = 128, 16
REDACTED = "[SECRET]"


@dataclass(frozen=True)
class SecretRule:
    """A match counts if its group `group` has at least `least` characters. Letters match in ASCII case only."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    ignore_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


BASE_RULES = (
    SecretRule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 16),
    SecretRule("hex", r"[0-9a-f]+", 0, 32),
)
RULES = (
    *BASE_RULES,
    SecretRule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    SecretRule("google", r"AIza[0-9A-Za-z_-]+", 0, 39),
    SecretRule("stripe", r"sk_live_[0-9A-Za-z]+", 0, 24),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)

ALL = ("all",)


def _both(a: tuple, b: tuple) -> tuple:
    return b if a == ALL else a if b == ALL or a == b else ("and", a, b)


def _either(queries: list[tuple]) -> tuple:
    if ALL in queries or not queries:
        return ALL
    distinct = list(dict.fromkeys(queries))
    return distinct[0] if len(distinct) == 1 else ("or", *distinct)


def _of_string(s: bytes) -> tuple:
    out = ALL
    for t in dict.fromkeys(s[i : i + 3] for i in range(len(s) - 2)):
        out = _both(out, ("tri", t))
    return out


def trigram_query(pattern: str) -> tuple:
    """("all",), ("tri", bytes), ("and", ...) or ("or", ...): what the lower-cased bytes of any text with a match satisfy."""

    def spelled(strings: set[bytes]) -> tuple:
        return _either([_of_string(s) for s in sorted(strings)])

    def walk(items) -> tuple[set[bytes] | None, tuple]:
        """The strings that a sequence can be, or None with the query it forces."""
        run, query, exact = {b""}, ALL, True

        def cut() -> None:
            nonlocal run, query, exact
            query, run, exact = _both(query, spelled(run)), {b""}, False

        for op, arg in items:
            strings, forced = one(str(op), arg)
            if strings is None:
                cut()
                query = _both(query, forced)
            elif len(run) * len(strings) > MOST_STRINGS:
                cut()
                run = strings if len(strings) <= MOST_STRINGS else {b""}
            else:
                run = {a + b for a, b in product(run, strings)}
        if exact:
            return run, ALL
        cut()
        return None, query

    def one(op: str, arg) -> tuple[set[bytes] | None, tuple]:
        if op == "LITERAL":
            return {chr(arg).encode().lower()}, ALL
        if op == "IN":
            chars: set[bytes] = set()
            for kind, x in arg:
                if str(kind) == "LITERAL":
                    chars.add(chr(x).encode().lower())
                elif str(kind) == "RANGE" and x[1] - x[0] < 4 * MOST_CHARS:
                    chars |= {chr(c).encode().lower() for c in range(x[0], x[1] + 1)}
                else:
                    return None, ALL
            return (chars, ALL) if len(chars) <= MOST_CHARS else (None, ALL)
        if op == "SUBPATTERN":
            return walk(arg[-1])
        if op == "BRANCH":
            parts = [walk(x) for x in arg[1]]
            if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= MOST_STRINGS:
                return set().union(*(s for s, _ in parts)), ALL
            return None, _either([q if s is None else spelled(s) for s, q in parts])
        if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = arg
            strings, forced = walk(inner)
            if strings is not None and int(most) == 1 and int(least) == 0:
                return strings | {b""}, ALL
            if strings is not None and int(least) == int(most) and len(strings) ** int(least) <= MOST_STRINGS:
                return {b"".join(p) for p in product(strings, repeat=int(least))}, ALL
            return None, ALL if int(least) == 0 else forced if strings is None else spelled(strings)
        if op == "AT":
            return {b""}, ALL
        return None, ALL

    strings, query = walk(regex_tree.parse(pattern))
    return query if strings is None else spelled(strings)


def _trigrams(query: tuple) -> set[bytes]:
    return {query[1]} if query[0] == "tri" else set().union(*(_trigrams(q) for q in query[1:])) if query[0] in ("and", "or") else set()


class Scanner:
    def __init__(self, rules: tuple[SecretRule, ...] = RULES):
        self.rules = [(r, r.compiled(), trigram_query(r.pattern)) for r in rules]
        self.trigrams = sorted(set().union(*(_trigrams(q) for _, _, q in self.rules)))
        self.codes = np.array([int.from_bytes(t, "big") for t in self.trigrams], np.uint32)
        self.starts = np.zeros(1 << 16, bool)
        self.starts[self.codes >> 8] = True

    def postings(self, texts: list[bytes]) -> dict[bytes, np.ndarray]:
        """Trigram to the sorted numbers of the texts that hold it, for the trigrams of the queries."""
        data = np.frombuffer(b"\xff".join(texts).lower(), np.uint8)
        if len(data) < 3 or not len(self.codes):
            return {}
        ends = np.cumsum([len(t) + 1 for t in texts])
        at = np.flatnonzero(self.starts[(data[:-2].astype(np.uint16) << 8) | data[1:-1]])
        code = (data[at].astype(np.uint32) << 16) | (data[at + 1].astype(np.uint32) << 8) | data[at + 2]
        slot = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        real = self.codes[slot] == code
        slot, doc = slot[real], np.searchsorted(ends, at[real], side="right")
        pairs = np.unique(slot.astype(np.int64) * len(texts) + doc)
        slot, doc = pairs // len(texts), pairs % len(texts)
        bounds = np.searchsorted(slot, np.arange(len(self.codes) + 1))
        return {t: doc[bounds[i] : bounds[i + 1]] for i, t in enumerate(self.trigrams)}

    def candidates(self, query: tuple, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
        if query == ALL:
            return np.arange(n)
        if query[0] == "tri":
            return postings.get(query[1], np.empty(0, np.int64))
        parts = [self.candidates(q, postings, n) for q in query[1:]]
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out

    def block(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text its spans (start, number of the rule, end) in code points, sorted."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        postings = self.postings([t.encode() for t in texts])
        for k, (rule, pattern, query) in enumerate(self.rules):
            for i in self.candidates(query, postings, len(texts)).tolist():
                for m in pattern.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[i].append((m.start(), k, m.end()))
        for spans in found:
            spans.sort()
        return found

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        out, block, size = [], [], 0
        for t in texts:
            if block and size + len(t) > BLOCK_BYTES:
                out += self.block(block)
                block, size = [], 0
            block.append(t)
            size += len(t)
        return out + (self.block(block) if block else [])


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each run of overlapping spans replaced."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], REDACTED]
        at = max(at, end)
    return "".join(out) + text[at:]


def found_secrets(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) for every row of docs(doc_id, text); null texts are empty.

    Spans are sorted by start, then by the rules' order. Other columns, whatever their names, are ignored; a null id
    stays null; repeated rows are treated each; very long texts are taken whole; an empty table gives an empty one.
    """
    names = [r.kind for r in rules]

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            rows = scanner.scan([t or "" for t in batch.column(1).to_pylist()])
            spans = pa.array([[{"kind": names[k], "start": s, "end": e} for s, k, e in row] for row in rows], pa.list_(kind))
            yield pa.RecordBatch.from_arrays([batch.column(0), spans], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redacted(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """docs, with all columns, whatever their names, and rows, with secrets in text replaced; a null text stays null. What
    found_secrets() says of odd rows holds here."""
    at = docs.columns.index("text")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            spans = scanner.scan([t or "" for t in texts])
            clean = [redact(t, s) if s else t for t, s in zip(texts, spans)]
            columns = [pa.array(clean, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def digests(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row of docs(doc_id, text): how many spans the
    base rules have, the digest of these spans as kind:start:end joined by commas, and all spans joined so. What
    found_secrets() says of odd rows holds here."""
    names = [r.kind for r in rules]
    base = len(BASE_RULES)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            rows = scanner.scan([t or "" for t in batch.column(1).to_pylist()])
            said = [[f"{names[k]}:{s}:{e}" for s, k, e in row] for row in rows]
            own = [",".join(x for x, (_, k, _) in zip(xs, row) if k < base) for xs, row in zip(said, rows)]
            counts = [pa.array([sum(k == n for _, k, _ in row) for row in rows], pa.int64()) for n in range(base)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array([hashlib.sha256(x.encode()).hexdigest() for x in own], pa.string()), pa.array([",".join(x) for x in said], pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
