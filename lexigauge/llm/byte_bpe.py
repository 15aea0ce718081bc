"""Exact byte-level BPE encoding and decoding in linear time by backtracking over longest matches.

The vocabulary's tokens, as Latin-1 strings of their bytes, form an Aho-Corasick automaton that gives the
longest token ending at each byte; from these and a table of each token's next shorter suffix the encoder
walks from the end of a piece: a token is taken only if it may stand beside the token after it, that is, if
merging both texts' bytes by rank would leave that boundary. Whether two tokens may be neighbours depends on
the pair alone and is memoised. Such a sequence exists once, and is what the merges by rank produce. Places
from which no sequence leads to the start are marked, so that each is tried once.

Text is split by the tokenizer's pattern first and each match is encoded alone; encoded pieces are memoised in a
bounded table. Decoding maps ids back to bytes.

Defined cases: null and empty text give no ids, the hash of the empty string and empty bytes; texts are taken whole;
repeated rows get the same result; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import sha256
from pathlib import Path

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import slices

#: Pieces, and pairs of tokens, held in a worker's memo before it starts anew.
MEMO = 250_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: one base64 token and its id in a line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


class Encoder:
    """Encoder and decoder of one vocabulary; every single byte must be a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks, self.split = ranks, regex.compile(pattern)
        self.bytes_of = {i: token for token, i in ranks.items()}
        self.size = {i: len(token) for token, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        #: for a token, the longest other token that it ends with
        self.shorter: dict[int, int] = {}
        #: the two tokens last merged to make a token
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, tuple[int, str, bytes]] = {}

    def _suffix(self, token: int) -> int:
        """The next shorter token with which a token ends; -1 after a single byte."""
        found = self.shorter.get(token)
        if found is None:
            whole, found = self.bytes_of[token], -1
            for k in range(1, len(whole)):
                if (found := self.ranks.get(whole[k:], -1)) >= 0:
                    break
            self.shorter[token] = found
        return found

    def _parts(self, token: int) -> tuple[int, int] | None:
        """The pair whose merge makes a token: its bytes merged by rank, without the last merge."""
        if token not in self.halves:
            whole = self.bytes_of[token]
            pieces = [whole[i : i + 1] for i in range(len(whole))]
            while len(pieces) > 2:
                rank, at = min(((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(pieces, pieces[1:], strict=False))), default=(1 << 60, 0))
                if rank >= token:
                    break
                pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
            self.halves[token] = (self.ranks[pieces[0]], self.ranks[pieces[1]]) if len(pieces) == 2 else None
        return self.halves[token]

    def neighbours(self, left: int, right: int) -> bool:
        """Whether both tokens, side by side, stay as they are under the merges by rank."""
        known = self.fits.get((left, right))
        if known is not None:
            return known
        a, b, limit, answer = left, right, 1 << 60, True
        # Undo merges at the boundary from the latest on. A merge across it that is due before the one undone would
        # have been made; of equal ranks the one further left is due first, so the right side's limit lies one higher.
        while True:
            across = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if across is not None and across < limit:
                answer = False
                break
            of_a, of_b = self._parts(a), self._parts(b)
            if of_a is None and of_b is None:
                break
            if of_b is None or (of_a is not None and a > b):
                limit, a = a, of_a[1]
            else:
                limit, b = b + 1, of_b[0]
        if len(self.fits) >= MEMO:
            self.fits.clear()
        self.fits[left, right] = answer
        return answer

    def piece(self, raw: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        size, fits, neighbours, suffix = self.size, self.fits, self.neighbours, self._suffix
        longest = [-1] * len(raw)
        for end, i in self.automaton.iter(raw.decode("latin-1")):
            if longest[end] < 0:  # of the matches that end at a byte, the automaton gives the longest first
                longest[end] = i
        dead = bytearray(len(raw) + 1)
        out: list[int] = []
        at, token, after = len(raw), longest[-1], -1
        while at:
            while token >= 0:
                if not dead[at - size[token]]:
                    if after < 0:
                        break
                    fit = fits.get((token, after))
                    if fit or (fit is None and neighbours(token, after)):
                        break
                token = suffix(token)
            if token >= 0:
                out.append(token)
                at -= size[token]
                after, token = token, longest[at - 1]
            else:
                dead[at] = 1
                if not out:
                    raise ValueError("the vocabulary lacks a single byte")
                token = out.pop()
                at += size[token]
                after, token = out[-1] if out else -1, suffix(token)
        return out[::-1]

    def known(self, piece: str) -> tuple[int, str, bytes]:
        """Count of ids, the ids as text, and the ids decoded again, of one match of the pattern."""
        ids = self.piece(piece.encode())
        if len(self.memo) >= MEMO:
            self.memo.clear()
        found = self.memo[piece] = (len(ids), ",".join(map(str, ids)), b"".join([self.bytes_of[i] for i in ids]))
        return found

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.split.findall(text) for i in self.piece(piece.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def digest(self, text: str) -> tuple[int, str, str]:
        """Count of ids, SHA-256 of the ids and of the bytes they decode to."""
        memo, known = self.memo, self.known
        parts = [memo.get(piece) or known(piece) for piece in self.split.findall(text)]
        ids = ",".join([p[1] for p in parts])
        return sum([p[0] for p in parts]), sha256(ids.encode()).hexdigest(), sha256(b"".join([p[2] for p in parts])).hexdigest()


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per process and vocabulary."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(read_ranks(path), pattern)
    return _ENCODERS[path, pattern]


def _shipped(docs: DataFrame, path: str) -> str:
    """Send the rank file to the executors; returns the name under which they find it."""
    docs.sparkSession.sparkContext.addFile(path)
    return Path(path).name


def encode_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256) for ``docs (doc_id, text)``."""
    name = _shipped(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(SparkFiles.get(name), pattern)
        for batch in slices(batches):
            found = [codec.digest(t or "") for t in batch.column("text").to_pylist()]
            counts, ids, back = ([x[k] for x in found] for k in range(3))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with a column ``ids array<int>`` of token ids; a column of that name is replaced."""
    name, rest = _shipped(docs, path), [c for c in docs.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(SparkFiles.get(name), pattern)
        for batch in slices(batches):
            ids = [codec.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(ids, pa.list_(pa.int32()))], names=[*rest, "ids"])

    from pyspark.sql.types import ArrayType, IntegerType, StructType

    held = docs.select(rest)
    return held.mapInArrow(run, StructType([*held.schema.fields, *StructType().add("ids", ArrayType(IntegerType(), False)).fields]))


def decode_ids(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows (doc_id, text) of ``tokens (doc_id, ids)``; bytes that aren't UTF-8 become replacement characters."""
    name = _shipped(tokens, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(SparkFiles.get(name), pattern)
        for batch in slices(batches):
            texts = [codec.decode(x or []).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids").mapInArrow(run, "doc_id bigint, text string")
