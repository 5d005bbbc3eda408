"""Removal of repeated passages by difference-cover anchors.

A difference cover of a period holds, for any two places, an offset below the period that takes
both into the cover. Hashing short windows only at cover places therefore gives any two equal
long windows one aligned pair of equal anchors. Anchors that occur twice mark the long windows
around them; only these are hashed whole (96 bits beside the bucket's number) and
compared over the corpus, for the smallest document that has each.

Both comparisons send each chunk's distinct hashes to buckets of the hash and get one bit back
for each, so a passage in a third of all documents costs one entry a chunk, and no pair of
documents is ever formed.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.words import Chunk, WordHashes, bucket_of, chunks, from_planes, planes, window_hash
from terrapanel.session import checkpointed

WINDOW = 13
#: Periods with their smallest difference covers.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}
#: Text bytes for each bucket of hashes.
BUCKET_BYTES = 64 << 20
_PARTS = ("ids", "nulls", "sizes", "blob")


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of at least half the window."""
    period = max(p for p in COVERS if p == 1 or 2 * (p - 1) < window)
    return period, COVERS[period]


class Places:
    """What every pass derives from a chunk: anchors and long windows."""

    def __init__(self, chunk: Chunk, window: int, known: WordHashes) -> None:
        self.chunk, self.window = chunk, window
        self.words, self.ends = chunk.hashes(known)
        n = len(self.words)
        sizes = np.diff(self.ends, prepend=0)
        left = np.repeat(self.ends, sizes) - np.arange(n)  # words from here to the document's end
        period, cover = cover_for(window)
        short = window - period + 1
        self.reach = period
        at = np.arange(max(0, n - short + 1))
        usable = np.isin(at % period, cover) & (left[: len(at)] >= short) & np.repeat(sizes >= window, sizes)[: len(at)]
        self.at = at[usable]
        self.anchors = window_hash(self.words, short, 0)[self.at]
        self.starts = np.arange(max(0, n - window + 1))
        self.starts = self.starts[left[: len(self.starts)] >= window]

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold a shared anchor; ``shared`` follows ``at``."""
        marks = np.zeros(len(self.words) + self.reach + 1, dtype=np.int64)
        marks[self.at[shared] + 1] = 1
        seen = np.cumsum(marks)
        return self.starts[seen[self.starts + self.reach] > seen[self.starts]]

    def windows(self, starts: np.ndarray):
        """Distinct windows in the order (bucket key, rest), which one each start has, smallest document each."""
        first = window_hash(self.words, self.window, 0)[starts]
        second = (window_hash(self.words, self.window, 1)[starts] >> np.uint64(32)).astype(np.uint32)
        docs = self.chunk.ids[np.searchsorted(self.ends, starts, side="right")]
        order = np.lexsort((second, first))
        first, second = first[order], second[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        which = np.empty(len(order), dtype=np.int64)
        which[order] = np.cumsum(new) - 1
        least = np.minimum.reduceat(docs[order], np.flatnonzero(new)) if len(order) else docs
        return first[new], second[new], which, least, docs


def _split(buckets: np.ndarray):
    """Runs of equal, ascending buckets."""
    edges = np.flatnonzero(np.diff(buckets)) + 1
    for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(buckets)]):
        if hi > lo:
            yield int(buckets[lo]), lo, hi


def _bits_of(answers: list[dict] | None, n: int) -> np.ndarray:
    """Answers of all buckets of a chunk, in order of the hash."""
    if not answers:
        return np.zeros(n, dtype=bool)
    parts = [np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=a["n"]) for a in sorted(answers, key=lambda a: a["bucket"])]
    return np.concatenate(parts).astype(bool)


def _anchor_blocks(window: int, buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("hashes", pa.binary())])

    def run(batches):
        known = WordHashes()
        for b in batches:
            for i in range(b.num_rows):
                key, *parts = (c[i].as_py() for c in b.columns)
                distinct = np.unique(Places(Chunk.unpack(*parts), window, known).anchors)
                low = distinct.astype(np.uint32)
                rows = [(k, key, low[lo:hi].tobytes()) for k, lo, hi in _split(bucket_of(distinct, buckets))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


_ANSWER = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("n", pa.int32()), ("bits", pa.binary())])
_ANSWER_DDL = "chunk bigint, bucket int, n int, bits binary"


def _answers(table: pa.Table, marks: np.ndarray, sizes: list[int]) -> pa.Table:
    ends = np.cumsum(sizes).tolist()
    bits = [np.packbits(marks[b - n : b]).tobytes() for n, b in zip(sizes, ends)]
    return pa.Table.from_arrays([table["chunk"], table["bucket"], pa.array(sizes, pa.int32()), pa.array(bits, pa.binary())], schema=_ANSWER)


def _shared(table: pa.Table) -> pa.Table:
    """Of one bucket: which hashes more than one chunk sent. A chunk knows its own repeats."""
    blocks = [np.frombuffer(x.as_py(), np.uint32) for x in table["hashes"]]
    _, inverse, counts = np.unique(np.concatenate(blocks), return_inverse=True, return_counts=True)
    return _answers(table, counts[inverse.reshape(-1)] > 1, [len(x) for x in blocks])


def _candidate_starts(places: Places, answers: list[dict] | None) -> np.ndarray:
    distinct, inverse, counts = np.unique(places.anchors, return_inverse=True, return_counts=True)
    inverse = inverse.reshape(-1)
    return places.candidates(_bits_of(answers, len(distinct))[inverse] | (counts > 1)[inverse])


def _window_blocks(window: int, buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("first", pa.binary()), ("second", pa.binary()), ("least", pa.binary())])

    def run(batches):
        known = WordHashes()
        for b in batches:
            for i in range(b.num_rows):
                key, answers, *parts = (c[i].as_py() for c in b.columns)
                places = Places(Chunk.unpack(*parts), window, known)
                first, second, _, least, _ = places.windows(_candidate_starts(places, answers))
                rows = [
                    (k, key, first[lo:hi].tobytes(), second[lo:hi].tobytes(), planes(least[lo:hi]))
                    for k, lo, hi in _split(bucket_of(first, buckets))
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def _later(table: pa.Table) -> pa.Table:
    """Of one bucket: which windows occur in a smaller document than the chunk's smallest."""
    first = [np.frombuffer(x.as_py(), np.uint64) for x in table["first"]]
    a = np.concatenate(first)
    b = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table["second"]])
    least = np.concatenate([from_planes(x.as_py(), "<i8") for x in table["least"]])
    order = np.lexsort((b, a))
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    smallest = np.minimum.reduceat(least[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    marks = np.empty(len(a), dtype=bool)
    marks[order] = least[order] > smallest
    return _answers(table, marks, [len(x) for x in first])


def _remove(window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])

    def run(batches):
        known = WordHashes()
        for b in batches:
            for i in range(b.num_rows):
                anchors, later, *parts = (c[i].as_py() for c in b.columns)
                places = Places(Chunk.unpack(*parts), window, known)
                starts = _candidate_starts(places, anchors)
                _, _, which, least, docs = places.windows(starts)
                gone = starts[(_bits_of(later, len(least)) [which] | (docs > least[which]))] if len(starts) else starts
                steps = np.zeros(len(places.words) + 1, dtype=np.int64)
                np.add.at(steps, gone, 1)
                np.add.at(steps, gone + window, -1)
                keep = np.cumsum(steps[:-1]) == 0
                begin = 0
                rows, held = [], 0
                chunk = places.chunk
                for doc, (text, end) in enumerate(zip(chunk.texts, places.ends.tolist())):
                    mine = keep[begin:end]
                    left = b" ".join(compress(text.split(), mine.tolist()))
                    rows.append((None if chunk.nulls[doc] else int(chunk.ids[doc]), end - begin, int((~mine).sum()), left.decode()))
                    begin, held = end, held + len(left)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def _by_chunk(answers: DataFrame, name: str) -> DataFrame:
    return answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "n", "bits")).alias(name))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents without the words that repeat a window of a document with a smaller id.

    Returns doc_id, n_words, n_removed and text, the kept words joined by one blank. Words are
    what ASCII blanks part, compared unchanged. A null text has no words; a null id counts as
    larger than every other; rows with equal ids do not remove from each other. Other columns
    are ignored, and an empty table gives an empty result.
    """
    spark = docs.sparkSession
    laid = checkpointed(chunks(docs))
    total = laid.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    blocks = laid.select("chunk", *_PARTS).mapInArrow(_anchor_blocks(window, buckets), "bucket int, chunk bigint, hashes binary")
    shared = checkpointed(_by_chunk(blocks.groupBy("bucket").applyInArrow(_shared, _ANSWER_DDL), "anchors"))
    asked = laid.join(shared, "chunk", "left").select("chunk", "anchors", *_PARTS)
    blocks = asked.mapInArrow(
        _window_blocks(window, buckets), "bucket int, chunk bigint, first binary, second binary, least binary"
    )
    later = checkpointed(_by_chunk(blocks.groupBy("bucket").applyInArrow(_later, _ANSWER_DDL), "later"))
    told = laid.join(shared, "chunk", "left").join(later, "chunk", "left").select("anchors", "later", *_PARTS)
    return told.mapInArrow(_remove(window), "doc_id bigint, n_words bigint, n_removed bigint, text string")


#: Windows of 13 words with the smallest document of each; runs of later ones are the removed words.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
s AS (SELECT r, i FROM p JOIN (SELECT k, min(doc_id) AS least FROM p GROUP BY 1) USING (k) WHERE least < doc_id OR doc_id IS NULL AND least IS NOT NULL),
g AS (SELECT r, i, sum(CASE WHEN i <= q + 13 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS n
  FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS q FROM s)),
runs AS (SELECT r, min(i) AS a, max(i) + 12 AS z FROM g GROUP BY r, n),
cut AS (SELECT r, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z, CAST(sum(z - a + 1) AS BIGINT) AS n_removed FROM runs GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(array_to_string(CASE WHEN a IS NULL THEN w ELSE flatten(list_transform(
  range(0, len(a) + 1), lambda j: w[CASE WHEN j = 0 THEN 1 ELSE z[j] + 1 END : CASE WHEN j = len(a) THEN len(w) ELSE a[j + 1] - 1 END])) END, ' ')) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""
