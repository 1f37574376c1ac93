"""Byte-pair encoding of a corpus by backtracking over longest matches.

A sequence of tokens is the one that the merges would give exactly if every two neighbours are compatible:
no merge crosses their boundary before the two are complete. The encoder walks a piece of text from left
to right, takes the longest token that starts at the position (all matches of a piece come from one
Aho-Corasick pass), and keeps it if it is compatible with the token before. Otherwise it tries the next
shorter prefix of that token, and at the end of prefixes gives up the token before. Positions that turned
out to be dead are marked and never entered again, so the work is linear in the length of the piece.

Null and empty texts have no tokens: their ids are an empty list.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pattern that cuts text before the merges; fixed by the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern for text of ASCII characters only.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
_ANY, _ASCII, _OTHER = regex.compile(PATTERN), re.compile(ASCII_PATTERN, re.ASCII), re.compile(r"[^\x00-\x7f]")
#: Pieces remembered per worker and the longest piece remembered; both bound memory only.
MEMO_PIECES, MEMO_LENGTH = 300_000, 48
#: Pairs of tokens whose compatibility a worker remembers; bounds memory only.
MEMO_PAIRS = 2_000_000
#: A vocabulary up to this size is broadcast; a larger one is sent to the executors as a file.
MAX_VOCABULARY_BYTES = 16_000_000
#: Bytes of results that a worker gathers before it hands them on.
OUT_BYTES = 8 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file in the order of their ids, which must be 0, 1, 2, ..."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    if not all(tokens):
        raise ValueError("ids of the rank file have gaps")
    return tokens


class Encoder:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.length = [len(t) for t in tokens]
        self.shorter = [-1] * len(tokens)
        self.left, self.right = list(range(len(tokens))), list(range(len(tokens)))
        self.merge: dict[int, int] = {}
        self._pairs: dict[int, bool] = {}
        for i, t in enumerate(tokens):
            self._add(i, t)
        self._pairs.clear()  # answers given while merges were still missing
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.memo: dict[str, bytes] = {}
        self.offsets = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def _add(self, i: int, token: bytes) -> None:
        """Find the token's next shorter prefix and the two parts whose merge makes it."""
        for n in range(len(token) - 1, 0, -1):
            head = self.ids.get(token[:n], -1)
            if head < 0:
                continue
            if self.shorter[i] < 0:
                self.shorter[i] = head
            tail = self.ids.get(token[n:], -1)
            if 0 <= tail < i and head < i and self._compatible(head, tail):
                self.left[i], self.right[i] = head, tail
                self.merge[head << 20 | tail] = i
                return

    def _compatible(self, a: int, b: int) -> bool:
        """Whether tokens a and b can stand side by side.

        Both tokens are taken apart along their facing edges, the younger one first, back to single
        bytes. A pair met on the way with a merge older than both parents would have been merged. Of
        equal merges the left one comes first, hence the different comparison on the two sides.
        """
        until_a = until_b = 1 << 60
        merge, left, right = self.merge, self.left, self.right
        while True:
            m = merge.get(a << 20 | b)
            if m is not None and m < until_a and m <= until_b:
                return False
            if (a > b and right[a] != a) or left[b] == b:
                if right[a] == a:
                    return True
                until_a, a = a, right[a]
            else:
                until_b, b = b, left[b]

    def compatible(self, a: int, b: int) -> bool:
        """Pair-compatibility table, filled on first use."""
        at = a << 20 | b
        known = self._pairs.get(at)
        if known is None:
            if len(self._pairs) >= MEMO_PAIRS:
                self._pairs.clear()
            known = self._pairs[at] = self._compatible(a, b)
        return known

    def encode_bytes(self, piece: bytes) -> list[int]:
        """Exact merges of one piece."""
        n = len(piece)
        longest, reach = [-1] * n, [0] * n
        length, shorter = self.length, self.shorter
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            start = end + 1 - length[token]
            if length[token] > reach[start]:
                longest[start], reach[start] = token, length[token]
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0] if n else -1
        while at < n:
            while token >= 0 and (dead[at + length[token]] or (out and not self.compatible(out[-1], token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at] if at < n else -1
            else:
                if not out:
                    raise ValueError("a byte is missing in the vocabulary")
                dead[at] = 1
                token = out.pop()
                at -= length[token]
                token = shorter[token]
        return out

    def pieces(self, text: str) -> list[str]:
        """Cut a text by the pattern. Stretches of ASCII lines take the cheaper ASCII form of it.

        A text may be parted before any newline whose next character is no white space: the pattern
        always has a boundary there.
        """
        if text.isascii():
            return _ASCII.findall(text)
        out: list[str] = []
        begin, n = 0, len(text)
        hit = _OTHER.search(text)
        while hit:
            start = text.rfind("\n", begin, hit.start())
            while start > begin and text[start + 1].isspace():
                start = text.rfind("\n", begin, start)
            start = max(start, begin)
            end = text.find("\n", hit.end())
            while end >= 0 and (end + 1 == n or text[end + 1].isspace()):
                end = text.find("\n", end + 1)
            end = n if end < 0 else end
            if start > begin:
                out += _ASCII.findall(text[begin:start])
            out += _ANY.findall(text[start:end])
            begin, hit = end, _OTHER.search(text, end)
        if begin < n:
            out += _ASCII.findall(text[begin:])
        return out

    def packed(self, text: str | None) -> bytes:
        """Ids of a text as 32-bit integers."""
        if not text:
            return b""
        cut = self.pieces(text)
        try:
            return b"".join(map(self.memo.__getitem__, cut))
        except KeyError:
            memo = self.memo
            if len(memo) > MEMO_PIECES:
                memo.clear()
            extra = {}
            for p in set(cut).difference(memo):
                (memo if len(p) <= MEMO_LENGTH else extra)[p] = np.array(self.encode_bytes(p.encode("utf-8", "surrogatepass")), np.int32).tobytes()
            return b"".join([memo[p] if p in memo else extra[p] for p in cut] if extra else map(memo.__getitem__, cut))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a list of ids by the offset table: one gather, no loop over tokens."""
        ids = np.asarray(ids, np.int64)
        sizes = self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(sizes)
        steps = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)
        return self.bytes[np.repeat(self.offsets[ids], sizes) + steps].tobytes()


_made: dict[int, Encoder] = {}


class SharedEncoder:
    """A vocabulary on the driver, an encoder made once per Python worker."""

    def __init__(self, spark, path: str | None = None):
        path = path or default_vocabulary()
        tokens = read_ranks(path)
        self.key = zlib.crc32(b"\n".join(tokens))
        self.tokens = self.file = None
        if sum(map(len, tokens)) <= MAX_VOCABULARY_BYTES:
            self.tokens = spark.sparkContext.broadcast(tokens)
        else:
            spark.sparkContext.addFile(path)
            self.file = path.rsplit("/", 1)[-1]

    def get(self) -> Encoder:
        if self.key not in _made:
            _made.clear()
            _made[self.key] = Encoder(self.tokens.value if self.tokens is not None else read_ranks(SparkFiles.get(self.file)))
        return _made[self.key]


def _in_parts(batch: pa.RecordBatch, size) -> Iterator[tuple[pa.Array, list]]:
    """Keys and results of the texts of a batch, handed on whenever the results reach ``OUT_BYTES``.

    ``size(text)`` gives a result and its bytes. One text at a time is a Python string.
    """
    begin, out, held = 0, [], 0
    for i, text in enumerate(batch.column(1)):
        made, n = size(text.as_py())
        out.append(made)
        held += n
        if held >= OUT_BYTES:
            yield batch.column(0).slice(begin, i + 1 - begin), out
            begin, out, held = i + 1, [], 0
    yield batch.column(0).slice(begin), out


def _list_array(parts: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def encode_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``key, ids`` for every row; ids are those of the vocabulary without special tokens."""
    shared = SharedEncoder(documents.sparkSession, vocabulary)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = shared.get().packed
        for batch in batches:
            for keys, ids in _in_parts(batch, lambda t: (x := packed(t), len(x))):
                yield pa.RecordBatch.from_arrays([keys, _list_array(ids)], ["key", "ids"])

    out = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>")
    return out.withColumnRenamed("key", key)


def count_tokens(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``key, n_tokens`` for every row; 0 for null and empty texts."""
    shared = SharedEncoder(documents.sparkSession, vocabulary)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = shared.get().packed
        for batch in batches:
            for keys, counts in _in_parts(batch, lambda t: (len(packed(t)) // 4, 8)):
                yield pa.RecordBatch.from_arrays([keys, pa.array(counts, pa.int64())], ["key", "n_tokens"])

    out = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_tokens bigint")
    return out.withColumnRenamed("key", key)


def decode_documents(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``key, text`` of encoded rows, by the offset table; no ids give the empty text."""
    shared = SharedEncoder(encoded.sparkSession, vocabulary)
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.get()
        for batch in batches:
            column = batch.column(1)
            flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            texts = [encoder.decode(flat[a:b]).decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    out = encoded.select(F.col(key).alias("key"), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids")).mapInArrow(run, f"key {kind}, text string")
    return out.withColumnRenamed("key", key)
