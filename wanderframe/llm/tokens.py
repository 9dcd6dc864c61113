"""Byte-level BPE: token counts by heap and linked list, and exact encoding by prefix dynamic programming.

Both split a text by the GPT-2 pattern and treat each piece on its own; what a piece gives is remembered in
a bounded table while a task runs, and dropped with it. The vocabulary files are small public constants (about 50,000
entries, under MAX_FILE_BYTES), read on the driver through their path parameter and sent with the tasks.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import table, tidied

MAX_FILE_BYTES = 64 << 20
#: Pieces that a worker remembers (about 0.2 KB each), and the longest worth remembering.
MEMO_PIECES, MEMO_CHARS = 400_000, 64
#: Pairs of tokens that a worker remembers (about 0.1 KB each).
MEMO_PAIRS = 300_000
TOKEN_LIMIT = 1024


def file_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_FILE_BYTES + 1)
    if len(data) > MAX_FILE_BYTES:
        raise ValueError(f"{path} is larger than a vocabulary may be to be sent to every task")
    return data


def byte_symbols() -> dict[str, int]:
    """The printable characters that stand for bytes in .json vocabularies: printable Latin-1 ones stand for
    themselves, the others follow from code point 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Memo(dict):
    """Pieces to results, emptied when full."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, piece):
        out = self.compute(piece)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = out
        return out


class HeapCounter:
    """Counts tokens of a .json byte-level BPE vocabulary.

    A heap holds the adjacent pairs that can merge, by (rank, place); a linked list holds the symbols. The
    lowest pair is popped, its left symbol grows over the right one, and the two new neighbours are pushed.
    An entry whose symbols have changed meanwhile is skipped. The count is the symbols less the merges.
    """

    def __init__(self, tokenizer_json: bytes, pattern: str):
        spec = json.loads(tokenizer_json)
        vocab, byte_of = spec["model"]["vocab"], byte_symbols()
        self.byte_id = [0] * 256
        for char, b in byte_of.items():
            self.byte_id[b] = vocab[char]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_split = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.findall = regex.compile(pattern).findall
        self.memo = _Memo(self.count_piece)

    def count_piece(self, piece: str) -> int:
        ids = [self.byte_id[b] for b in piece.encode()]
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        merges, heap, merged = self.merges, [], 0
        for i in range(n - 1):
            if found := merges.get((ids[i], ids[i + 1])):
                heap.append((found[0], i, found[1]))
        heapq.heapify(heap)
        while heap:
            rank, i, new = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else -1
            if j < 0 or merges.get((ids[i], ids[j])) != (rank, new):
                continue
            merged += 1
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if found := merges.get((new, ids[k])):
                    heapq.heappush(heap, (found[0], i, found[1]))
            h = before[i]
            if h >= 0 and (found := merges.get((ids[h], new))):
                heapq.heappush(heap, (found[0], h, found[1]))
        return n - merged

    def count(self, text: str) -> int:
        """Special strings inside the text count one each, as the library's default has it."""
        parts, extra = [text], 0
        if self.special_split and any(s in text for s in self.special):
            parts = self.special_split.split(text)
            extra = len(parts) - 1
        lookup = self.memo.__getitem__
        return extra + sum(sum(map(lookup, self.findall(part))) for part in parts)


def token_counts(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, limit: int = TOKEN_LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs(doc_id, text); null texts count as empty.

    Other columns, whatever their names, are ignored; a null id
    stays null; repeated rows are treated each; very long texts are taken whole; an empty table gives an empty one.
    """
    data = docs.sparkSession.sparkContext.broadcast(file_bytes(path))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = HeapCounter(data.value, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = np.fromiter((counter.count(t) for t in texts), np.int64, len(texts))
            sizes = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(counts), pa.array(counts > limit)],
                                             ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


class PrefixEncoder:
    """Encodes pieces by the ranks of a .tiktoken file.

    For each prefix of a piece exactly one token can end its encoding. It is the longest token at the prefix's
    end that may follow the last token of the prefix before it, where a pair of tokens may stand together if
    merging its bytes would keep them apart. Walking the last tokens backwards gives the encoding. As every
    prefix keeps its own, appending costs only the new bytes, and after an edit only what follows it changes.
    """

    def __init__(self, tiktoken_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, tiktoken_file.splitlines())}
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.decimal = {r: str(r) for r in self.bytes_of}
        self.longest = max(map(len, self.ranks))
        self.findall = regex.compile(pattern).findall
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        # endings[b]: the lengths that tokens ending in these four bytes have, longest first, and then 3 and 2
        lengths: dict[bytes, set[int]] = {}
        for t in self.ranks:
            if len(t) >= 4:
                lengths.setdefault(t[-4:], set()).add(len(t))
        self.endings = {e: (*sorted(x, reverse=True), 3, 2) for e, x in lengths.items()}
        self.memo = _Memo(self._piece)

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes a token; None for a single byte, (-1, -1) if merging never makes it."""
        if token not in self.halves:
            parts = [bytes([b]) for b in self.bytes_of[token]]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
                if parts[best] + parts[best + 1] not in self.ranks:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            self.halves[token] = None if len(parts) == 1 else (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (-1, -1)
        return self.halves[token]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives just these two. Undoes their merges from the latest on: at
        each border between a right end and a left end no merge may have come before that undoing."""
        key = left << 32 | right
        if (known := self.pairs.get(key)) is not None:
            return known
        a, b, limit, ok = left, right, 1 << 60, True
        while True:
            joined = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], 1 << 60)
            if joined < limit:
                ok = False
                break
            sa, sb = self.split(a), self.split(b)
            if sa is None and sb is None:
                break
            # the later merge is undone first; of equal ones the right, as merging goes from the left
            if sb is None or (sa is not None and a > b):
                limit, a = a, sa[1]
            else:
                limit, b = b + 1, sb[0]
        if len(self.pairs) >= MEMO_PAIRS:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    def extend(self, data: bytes, last: list[int], upto: int) -> None:
        """Fills last, the last token of each prefix, from prefix len(last) + 1 to prefix upto."""
        ranks, endings, split, may_follow = self.ranks, self.endings, self.split, self.may_follow
        for end in range(len(last) + 1, upto + 1):
            for k in endings.get(data[end - 4 : end], (3, 2)) if end >= 4 else (3, 2)[3 - min(end, 3) :]:
                token = ranks.get(data[end - k : end]) if k <= end else None
                if token is not None and (k == end or may_follow(last[end - k - 1], token)) and split(token) != (-1, -1):
                    last.append(token)
                    break
            else:
                last.append(ranks[data[end - 1 : end]])

    def unwind(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes_of[last[end - 1]])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None and self.split(whole) != (-1, -1):
            return [whole]
        last: list[int] = []
        self.extend(piece, last, len(piece))
        return self.unwind(last)

    def _piece(self, piece: str) -> tuple[int, ...]:
        return tuple(self.encode_piece(piece.encode()))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, self.findall(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class EditableEncoding:
    """The encoding of one growing or edited byte string that is a single piece."""

    def __init__(self, encoder: PrefixEncoder, data: bytes = b""):
        self.encoder, self.data, self.last = encoder, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.encoder.extend(self.data, self.last, len(self.data))

    def replace(self, start: int, end: int, by: bytes) -> int:
        """Puts by in place of bytes start to end; returns how many prefixes were computed anew.

        Prefixes up to start stay. Behind the edit, once as many prefixes in a row as the longest token has
        bytes end as they did before, all later ones do too and are taken over.
        """
        old, shift = self.last, len(by) - (end - start)
        self.data = self.data[:start] + by + self.data[end:]
        self.last, same, at = old[:start], 0, start
        while at < len(self.data) and same < self.encoder.longest:
            at += 1
            self.encoder.extend(self.data, self.last, at)
            same = same + 1 if at > start + len(by) and self.last[-1] == old[at - shift - 1] else 0
        self.last += old[at - shift :]
        return at - start

    def ids(self) -> list[int]:
        return self.encoder.unwind(self.last)


def encoded(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids, n_tokens) for every row of docs(doc_id, text); null texts are empty.

    Other columns, whatever their names, are ignored; a null id
    stays null; repeated rows are treated each; very long texts are taken whole; an empty table gives an empty one.
    """
    data = docs.sparkSession.sparkContext.broadcast(file_bytes(path))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PrefixEncoder(data.value, pattern)
        for batch in batches:
            ids = [encoder.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64())], ["doc_id", "ids", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, n_tokens long")


def encoding_digests(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, and the ids decoded again. Odd rows are treated
    as by encoded()."""
    data = docs.sparkSession.sparkContext.broadcast(file_bytes(path))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PrefixEncoder(data.value, pattern)
        for batch in batches:
            counts, ids_sha, back_sha = [], [], []
            for text in batch.column(1).to_pylist():
                ids = encoder.encode(text or "")
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(encoder.decimal.__getitem__, ids)).encode()).hexdigest())
                back_sha.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def count_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def encode_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
