"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece there is exactly one token that can end its encoding. The table of those last tokens
is filled from left to right: token t can end prefix i if the encoding of the prefix before t may be followed by t,
which depends only on that prefix's own last token. Walking the table back from its end gives the encoding, so
appending bytes only adds entries, and after an edit only the entries behind it are filled again.
"""

from __future__ import annotations

import base64
import functools
import itertools
import os
import sys

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.llm.common import table

NAME = "op10_bpe"
RANKS = "byte_bpe_multi_50k.tiktoken"
#: Entries that a worker keeps in each of its caches of encoded pieces; a full cache is emptied, results are the same.
CACHE = 300_000
#: Pieces of up to so many characters are kept for later ones, so that the cache is bounded in bytes too.
KNOWN = 48
#: Bytes of text in a batch of results.
BATCH_BYTES = 4_000_000


def public_vocabulary(name: str = RANKS) -> tuple[str, str]:
    """The path of a public rank file, and the pattern that splits text for it."""
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        sys.path.append("/opt")
        sys.path.append("/opt/tokenizers")
        import public_tokenizers
    return public_tokenizers.path(name), public_tokenizers.PATTERN


class Vocabulary:
    """Ranks of byte strings, and which tokens may stand next to each other."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        #: A trie of the tokens' bytes read backwards, node << 8 | byte: next node, and the token of each node.
        self.trie: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        for b, t in ranks.items():
            node = 0
            for x in reversed(b):
                after = self.trie.get(node << 8 | x)
                if after is None:
                    after = self.trie[node << 8 | x] = len(self.token_at)
                    self.token_at.append(-1)
                node = after
            self.token_at[node] = t
        self.joined: dict[tuple[int, int], int | None] = {}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[int, bool] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one, (token, token) for a single byte, None if no merge makes it."""
        if token not in self.parts:
            piece = self.bytes_of[token]
            ends = [piece[i : i + 1] for i in range(len(piece))]
            while len(ends) > 2:
                rank, at = min(((self.ranks.get(a + b, len(self.ranks) + 1), i) for i, (a, b) in enumerate(itertools.pairwise(ends))))
                if rank >= token:
                    break
                ends[at : at + 2] = [ends[at] + ends[at + 1]]
            if len(ends) == 1:
                self.parts[token] = (token, token)
            else:
                self.parts[token] = (self.ranks[ends[0]], self.ranks[ends[1]]) if len(ends) == 2 and all(x in self.ranks for x in ends) else None
        return self.parts[token]

    def _join(self, a: int, b: int) -> int:
        key = (a, b)
        found = self.joined.get(key)
        if found is None:
            if len(self.joined) > 4 * CACHE:
                self.joined.clear()
            found = self.joined[key] = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], 1 << 30)
        return found

    def adjacent(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both, from single bytes on, ends with exactly these two tokens.

        It undoes the merges next to the border, the latest first: the pair stands unless some pair across the
        border has a rank that would have been merged before.
        """
        key = left << 32 | right
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) > 4 * CACHE:
                self.fits.clear()
            found = self.fits[key] = self.split(right) is not None and self._adjacent(left, right)
        return found

    def _adjacent(self, a: int, b: int) -> bool:
        limit = 1 << 30  # the merge across the border would have to come before the merge that is undone next
        while True:
            if self._join(a, b) < limit:
                return False
            (a1, a2), (b1, b2) = self.split(a), self.split(b)
            whole_a, whole_b = a1 == a == a2, b1 == b == b2
            if whole_a and whole_b:
                return True
            # of equal merges the left one comes first: undo the right token first on equal ranks
            if whole_a or (not whole_b and b >= a):
                limit, b = b + 1, b1
            else:
                limit, a = a, a2

    def end(self, p: bytes, i: int, last: list[int]) -> int:
        """The last token of p[:i + 1], from the last tokens of all shorter prefixes."""
        step, token_at, fits = self.trie.get, self.token_at, self.fits.get
        node = 0
        for j in range(i, -1, -1):
            node = step(node << 8 | p[j])
            if node is None:
                break
            t = token_at[node]
            if t < 0:
                continue
            if not j:
                if self.split(t) is not None:
                    return t
                break
            before = last[j - 1]
            ok = fits(before << 32 | t)
            if ok is None:
                ok = self.adjacent(before, t)
            if ok:
                return t
        raise ValueError(f"no token ends {p[: i + 1]!r}: the vocabulary lacks single bytes")


class PrefixTable:
    """The last token of every prefix of a byte string, which may grow or be edited."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, b"", []
        self.append(piece)

    def append(self, more: bytes) -> PrefixTable:
        self.piece += more
        self._fill()
        return self

    def edit(self, start: int, end: int, new: bytes) -> PrefixTable:
        """Replace piece[start:end]; entries of prefixes up to start stay."""
        self.piece = self.piece[:start] + new + self.piece[end:]
        del self.last[start:]
        self._fill()
        return self

    def _fill(self) -> None:
        piece, last, end = self.piece, self.last, self.vocabulary.end
        for i in range(len(last), len(piece)):
            last.append(end(piece, i, last))

    def tokens(self) -> list[int]:
        out, i, lengths = [], len(self.piece), self.vocabulary.bytes_of
        while i:
            t = self.last[i - 1]
            out.append(t)
            i -= len(lengths[t])
        return out[::-1]


class Codec:
    """Encodes and decodes whole texts; pieces that were met before come from a cache."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.split = vocabulary, regex.compile(pattern).findall
        #: The ids of pieces as bytes, of those met lately and of those before.
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def piece(self, s: str) -> list[int]:
        b = s.encode()
        whole = self.vocabulary.ranks.get(b)
        return [whole] if whole is not None else PrefixTable(self.vocabulary, b).tokens()

    def _met(self, s: str) -> bytes:
        found = self.pieces.get(s)
        if found is None:
            found = self.older.get(s)
            if found is None:
                found = np.array(self.piece(s), np.int32).tobytes()
            if len(s) <= KNOWN:
                if len(self.pieces) >= CACHE:
                    self.pieces, self.older = {}, self.pieces
                self.pieces[s] = found
        return found

    def encoded(self, text: str) -> bytes:
        """The ids of a text, four bytes each."""
        pieces = self.split(text)
        found = list(map(self.pieces.get, pieces))
        if None in found:
            found = [self._met(s) if ids is None else ids for s, ids in zip(pieces, found, strict=True)]
        return b"".join(found)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encoded(text), np.int32).tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(Vocabulary.load(path), pattern)


SCHEMA = "doc_id long, ids array<int>, decoded binary"


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the token ids of each whole text, and the bytes that decoding those ids gives.

    A null text counts as empty and gives no ids; a null doc_id stays null; repeated rows give repeated results, an
    empty table none. Other columns are not read. Texts are worked on one by one, without a shuffle, so the longest
    single text bounds the memory. Every executor needs the rank file at path.
    """

    def run(batches):
        c = codec(path, pattern)
        text = ids = decoded = None
        for batch in batches:
            ids_of, texts = batch.column(0), batch.column(1)
            out: tuple[list, list, list] = ([], [], [])
            held = 0
            for i in range(len(texts)):
                now = texts[i].as_py() or ""
                if now != text:  # copies that follow each other are encoded and decoded once
                    text, ids = now, c.encoded(now)
                    decoded = c.decode(np.frombuffer(ids, np.int32).tolist())
                for column, x in zip(out, (ids_of[i].as_py(), ids, decoded), strict=True):
                    column.append(x)
                held += len(decoded)
                if held >= BATCH_BYTES:
                    yield _batch(out)
                    out, held = ([], [], []), 0
            if out[0]:
                yield _batch(out)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def _batch(out) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in out[1]])]).astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(out[1]), np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), ids, pa.array(out[2], pa.binary())], names=["doc_id", "ids", "decoded"])


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_vocabulary()
    return digests(encode_decode(table(spark, sf_dir, "documents"), os.fspath(path), pattern))


#: SQL has no byte-pair encoding; tests hold the codec against the tiktoken library.
ORACLE_SQL = None
