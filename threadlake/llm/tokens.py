"""Encoding with a public byte-level BPE vocabulary, by prefix dynamic programming.

For every prefix of a piece of text there is exactly one last token that a valid encoding of the prefix can
end with. The table of these last tokens is filled from left to right: a token fits at a place if it and the
last token before it stay two tokens when their bytes are merged in order of rank. The encoding is read off
backwards. The table makes appending exact and cheap, and after an edit only the part around it is encoded
again: once as many places as the longest token agree with the old table, the rest agrees too.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from threadlake.session import table

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
# fixed value: the pattern that splits text before encoding, as published with the vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 400_000  # pieces and pairs whose encoding a worker remembers; others are encoded again


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PrefixTable:
    """The last token of every prefix of a byte string; can be appended to and edited."""

    def __init__(self, encoder: Encoder, data: bytes = b"") -> None:
        self.encoder, self.data, self.last = encoder, bytearray(), []
        self.append(data)

    def append(self, data: bytes) -> None:
        start = len(self.data)
        self.data += data
        self.last += [-1] * len(data)
        for end in range(start + 1, len(self.data) + 1):
            self.last[end - 1] = self._fit(end)

    def _fit(self, end: int) -> int:
        encoder, data, last = self.encoder, self.data, self.last
        for size in range(min(encoder.longest, end), 0, -1):
            token = encoder.ranks.get(bytes(data[end - size : end]))
            if token is None or not encoder.whole(token):
                continue
            if size == end or (last[end - size - 1] >= 0 and encoder.fits(last[end - size - 1], token)):
                return token
        return -1

    def edit(self, start: int, stop: int, data: bytes) -> int:
        """Replace bytes start to stop; gives the number of places that were filled again."""
        tail = self.last[stop:]
        self.data[start:stop] = data
        self.last = self.last[:start] + [-1] * len(data) + tail
        agreed = filled = 0
        for end in range(start + 1, len(self.data) + 1):
            token = self._fit(end)
            filled += 1
            agreed = agreed + 1 if end > start + len(data) and self.last[end - 1] == token else 0
            self.last[end - 1] = token
            if agreed >= self.encoder.longest:
                break
        return filled

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.encoder.pieces[self.last[end - 1]])
        return out[::-1]


class Encoder:
    """Encodes texts with a vocabulary of ranks. Text that reads like a special token is ordinary text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.pieces = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks))
        self._words: dict[str, tuple[int, ...]] = {}
        self._pairs: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}

    def _merge(self, data: bytes) -> list[bytes]:
        """Merging in order of rank, for the few bytes of a token or of two."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def whole(self, token: int) -> bool:
        """Whether the bytes of the token are encoded as that token."""
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = len(self._merge(self.pieces[token])) == 1
        return known

    def fits(self, a: int, b: int) -> bool:
        """Whether token b can follow token a: their bytes are encoded as these two."""
        key = a << 32 | b
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= CACHE:
                self._pairs.clear()
            left, right = self.pieces[a], self.pieces[b]
            known = self._pairs[key] = self._merge(left + right) == [left, right]
        return known

    def word(self, word: str) -> tuple[int, ...]:
        if len(self._words) >= CACHE:
            self._words.clear()
        data = word.encode("utf-8", "replace")
        token = self.ranks.get(data)
        out = (token,) if token is not None and self.whole(token) else tuple(PrefixTable(self, data).tokens())
        if len(word) <= 64:
            self._words[word] = out
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self._words.get
        for w in self.pattern.findall(text):
            out += known(w) or self.word(w)
        return out

    def count(self, text: str) -> int:
        known = self._words.get
        return sum(len(known(w) or self.word(w)) for w in self.pattern.findall(text))


class Growing:
    """A text whose encoding is kept up to date while text is appended."""

    def __init__(self, encoder: Encoder, text: str = "") -> None:
        self.encoder, self.ids, self._starts, self.text = encoder, [], [], ""
        self.append(text)

    def append(self, text: str) -> None:
        # only the last pieces can take up appended text; what stands before them is final
        keep = max(0, len(self._starts) - 2)
        at, known = self._starts[keep] if keep < len(self._starts) else (len(self.text), len(self.ids))
        self.text += text
        del self.ids[known:], self._starts[keep:]
        for piece in self.encoder.pattern.finditer(self.text, at):
            self._starts.append((piece.start(), len(self.ids)))
            self.ids += self.encoder.word(piece.group())


_worker: dict[str, Encoder] = {}


def _worker_encoder(shared) -> Encoder:
    """One encoder a Python worker, so that what it remembers serves all its tasks."""
    if shared.id not in _worker:
        _worker.clear()
        _worker[shared.id] = Encoder(shared.value)
    return _worker[shared.id]


class _Shared:
    """The vocabulary on its way to the workers: a broadcast of fixed size, some 50,000 entries."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.broadcast = spark.sparkContext.broadcast(read_ranks(path))
        self.id = f"{path}:{self.broadcast._jbroadcast.id()}"

    @property
    def value(self) -> dict[bytes, int]:
        return self.broadcast.value


def _texts(column: pa.ChunkedArray | pa.Array) -> Iterable[str | None]:
    return (x.as_py() for x in column)


def encode_texts(df: DataFrame, key: str, text: str, path: str = f"{TOKENIZERS}/{VOCABULARY}.tiktoken") -> DataFrame:
    """(key, ids) of every row; [] for an empty and for a null text. Rows are not joined or moved; any text length."""
    shared = _Shared(df.sparkSession, path)
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker_encoder(shared)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                ids, ends = [], [0]
                for value in _texts(part.column(1)):
                    if value:
                        ids += encoder.encode(value)
                    ends.append(len(ids))
                lists = pa.ListArray.from_arrays(pa.array(np.asarray(ends, np.int32)), pa.array(np.asarray(ids, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], [key, "ids"])

    return df.select(key, text).mapInArrow(run, schema)


def count_tokens(df: DataFrame, key: str, text: str, path: str = f"{TOKENIZERS}/{VOCABULARY}.tiktoken") -> DataFrame:
    """(key, n_tokens) of every row; 0 for an empty and for a null text."""
    shared = _Shared(df.sparkSession, path)
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("n_tokens", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker_encoder(shared)
        for batch in batches:
            counts = [encoder.count(v) if v else 0 for v in _texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], [key, "n_tokens"])

    return df.select(key, text).mapInArrow(run, schema)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"p8_ids": p8_ids}
SQL: dict[str, str] = {}
