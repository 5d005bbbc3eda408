"""Words, their hashes and chunks of documents, shared by the operators that compare texts.

Documents are laid out once in stored chunks of bounded size. A word's place is its flat index in
its chunk, so whole chunks are handled as numpy arrays and answers from elsewhere need one bit a
place. A chunk's content never changes after it is written, and every pass derives the same
arrays from it, also after a lost executor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text bytes of a chunk; a longer document gets a chunk of its own.
CHUNK_BYTES = 4 << 20
#: Words whose hash a worker remembers before it starts afresh.
REMEMBERED_WORDS = 300_000
#: Order of a document without id: after all others.
NO_ID = np.iinfo(np.int64).max
_BLANKS = b" \t\n\r\x0b\x0c"
#: An odd multiplier for polynomial window hashes and one to mix their bits.
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    """16-byte hash of each word, computed once a worker."""

    def __missing__(self, word: bytes) -> bytes:
        digest = self[word] = xxhash.xxh3_128_digest(word)
        return digest


def segments(text: bytes, size: int = CHUNK_BYTES) -> Iterator[bytes]:
    """The text cut at blanks into parts of about ``size`` bytes."""
    at = 0
    while at < len(text):
        to = at + size
        while to < len(text) and text[to] not in _BLANKS:
            to += 1
        yield text[at:to]
        at = to


def hashed_words(text: bytes, known: WordHashes) -> np.ndarray:
    """Two unsigned 64-bit hashes a word; words are what ASCII blanks part."""
    parts = []
    for segment in segments(text):
        if len(known) > REMEMBERED_WORDS:
            known.clear()
        parts.append(b"".join(map(known.__getitem__, segment.split())))
    return np.frombuffer(b"".join(parts), dtype="<u8").reshape(-1, 2)


def window_hash(words: np.ndarray, k: int, lane: int) -> np.ndarray:
    """Hash of every ``k`` consecutive words, by one lane of their hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    column = np.ascontiguousarray(words[:, lane])
    out = np.zeros(n, dtype=np.uint64)
    factor = 1
    for j in range(k):
        out += column[j : j + n] * np.uint64(factor)
        factor = factor * _MULTIPLIERS[lane] & (1 << 64) - 1
    return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _MIX
    x = (x ^ x >> np.uint64(32)) * _MIX
    return x ^ x >> np.uint64(32)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of the upper half of the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def planes(values: np.ndarray) -> bytes:
    """Bytes of ``values`` by significance: equal high bytes stand together and compress away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def from_planes(data: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


@dataclass
class Chunk:
    """Documents of a chunk: ids (``NO_ID`` for null) and texts as UTF-8."""

    ids: np.ndarray
    nulls: np.ndarray
    texts: list[bytes]

    @classmethod
    def unpack(cls, ids: bytes, nulls: bytes, sizes: bytes, blob: bytes) -> Chunk:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        ends = np.cumsum(np.frombuffer(sizes, "<i8"))
        texts = [raw[a:b] for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist())] if len(ends) else []
        return cls(np.frombuffer(ids, "<i8"), np.frombuffer(nulls, np.bool_), texts)

    def hashes(self, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and the flat index at which each document ends."""
        parts = [hashed_words(t, known) for t in self.texts]
        ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
        return np.concatenate(parts) if parts else np.zeros((0, 2), np.uint64), ends


CHUNK_DDL = "chunk bigint, n_bytes bigint, ids binary, nulls binary, sizes binary, blob binary"


def chunks(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = CHUNK_BYTES) -> DataFrame:
    """Lay documents out in chunks; store the result before using it. Null texts are empty."""
    schema = pa.schema([("chunk", pa.int64()), ("n_bytes", pa.int64()), *((n, pa.binary()) for n in ("ids", "nulls", "sizes", "blob"))])

    def lay(batches):
        made = 0
        ids, texts, total = [], [], 0

        def row() -> pa.RecordBatch:
            nonlocal made, total
            values = (
                (TaskContext.get().partitionId() << 32) + made, total,
                np.array([NO_ID if i is None else i for i in ids], "<i8").tobytes(),
                np.array([i is None for i in ids], np.bool_).tobytes(),
                np.array([len(t) for t in texts], "<i8").tobytes(),
                zstandard.ZstdCompressor(level=3).compress(b"".join(texts)),
            )
            made, total = made + 1, 0
            ids.clear()
            texts.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, schema.types)], schema=schema)

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                data = (text.as_py() or "").encode()
                if texts and total + len(data) > size:
                    yield row()
                ids.append(key)
                texts.append(data)
                total += len(data)
        if texts:
            yield row()

    return docs.select(F.col(id_column).cast("bigint"), F.col(text_column).cast("string")).mapInArrow(lay, CHUNK_DDL)
