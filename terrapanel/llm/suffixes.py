"""Removal of repeated byte strings by suffix arrays of shards.

A string of the window's length is known by its anchor, the least hash of its 150-byte strings, and
lies in a segment: the run of windows that share an occurrence of the anchor. Equal windows have
equal anchors at equal offsets, so a window repeats if its whole segment repeats or if another
segment of the same anchor holds it. Segments are counted by (anchor, hash of the bytes). Only
different segments of one anchor need comparing; each goes once, from the chunk that holds its
first copy, to the shard of its anchor, where suffixes are sorted by induction in external memory
and neighbours that share a whole window are marked. Answers, a bit a window, return to all chunks
that hold the segment.

An anchor whose different segments exceed a stated size is split: its windows are grouped anew by
ranges of the anchor's offset and the bytes that all windows of a range share, down to single
windows, which need no comparing. So no group is too large for a shard.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrapanel.llm import induced
from terrapanel.llm.words import CHUNK_BYTES, Chunk, chunks, mixed
from terrapanel.session import checkpointed

WINDOW = 400
#: Text bytes whose segments are cut at a time; places in them take 24 bits.
PIECE = 2 << 20
#: Text bytes of a shard, about, and the most that different segments of one anchor may hold unsplit.
SHARD_BYTES = 64 << 20
#: Offsets of the anchor that a split anchor's windows share a group over.
SPLITS = (32, 1)
_ODD = 0x9E3779B97F4A7C15
_PARTS = ("ids", "nulls", "sizes", "blob")


def gram_size(window: int) -> int:
    return max(1, window * 3 // 8)


class Grams:
    """Hash of every string of ``k`` bytes, by sums of bytes times powers of an odd number."""

    def __init__(self, k: int, longest: int) -> None:
        self.k = k
        self.powers, self.inverse = (np.full(longest + 1, base, np.uint64) for base in (_ODD, pow(_ODD, -1, 1 << 64)))
        for x in (self.powers, self.inverse):
            x[0] = 1
            np.cumprod(x, out=x)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        sums = np.zeros(n + 1, np.uint64)
        np.multiply(data, self.powers[:n], out=sums[1:], dtype=np.uint64, casting="unsafe")
        np.cumsum(sums, out=sums)
        out = sums[self.k :] - sums[: n + 1 - self.k]
        out *= self.inverse[: len(out)]
        return mixed(out)


def least_places(hashes: np.ndarray, span: int) -> np.ndarray:
    """For every ``span`` consecutive hashes the place of the least by its upper 40 bits, the first of equals."""
    n, bits = len(hashes), 24
    key = (hashes >> np.uint64(bits) << np.uint64(bits)) | np.arange(n, dtype=np.uint64)
    pad = -n % span
    blocks = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(back[: n - span + 1], ahead[span - 1 : n]) & np.uint64((1 << bits) - 1)).astype(np.int64)


def segments(texts: list[bytes], window: int, grams: Grams, piece: int = PIECE) -> tuple[np.ndarray, ...]:
    """Start, number of windows, place of the anchor and its hash for all segments of joined texts."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts_at = np.zeros(len(data) + 1, np.int8)
    at = 0
    for t in texts:
        if len(t) >= window:
            starts_at[at] += 1
            starts_at[at + len(t) - window + 1] -= 1
        at += len(t)
    usable = np.cumsum(starts_at[:-1], dtype=np.int8).astype(bool)
    out = []
    for lo in range(0, len(data) - window + 1, piece):
        part = data[lo : lo + piece + window - 1]
        hashes = grams.hashes(part)
        least = least_places(hashes, window - grams.k + 1)
        ok = usable[lo : lo + len(least)]
        new = ok.copy()
        new[1:] &= ~ok[:-1] | (least[1:] != least[:-1])
        first = np.flatnonzero(new)
        if len(first):
            # A segment's windows are those up to the next one that are usable.
            n = np.add.reduceat(ok.astype(np.int64), first)
            out.append((first + lo, n, least[first] + lo, hashes[least[first]].view(np.int64)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out))


def _digest(data, seed: int = 0) -> int:
    h = xxhash.xxh3_64_intdigest(data, seed)
    return h - (1 << 64) if h >> 63 else h


_SEGMENT = pa.schema([
    ("chunk", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()), ("place", pa.int64()), ("anchor", pa.int64()),
    ("digest", pa.int64()), ("n", pa.int64()),
])
_SEGMENT_DDL = "chunk bigint, start bigint, windows int, place bigint, anchor bigint, digest bigint, n bigint"


def _segment_batch(chunk: int, start, n, place, anchor, raw: bytes, window: int) -> pa.RecordBatch:
    """Rows of a chunk's segments; the first of equal ones carries their number, the others 0."""
    view = memoryview(raw)
    digest = np.array([_digest(view[a : a + k + window - 1]) for a, k in zip(start.tolist(), n.tolist())], np.int64)
    both = digest.view(np.uint64) * np.uint64(_ODD) + anchor.view(np.uint64)
    _, first, counts = np.unique(both, return_index=True, return_counts=True)
    times = np.zeros(len(start), np.int64)
    times[first] = counts
    columns = (np.full(len(start), chunk), start, n, place, anchor, digest, times)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SEGMENT)], schema=_SEGMENT)


def _cut(window: int, piece: int):
    def run(batches):
        grams = Grams(gram_size(window), piece + window)
        for b in batches:
            for i in range(b.num_rows):
                key, *parts = (c[i].as_py() for c in b.columns)
                texts = Chunk.unpack(*parts).texts
                found = segments(texts, window, grams, piece)
                if len(found[0]):
                    yield _segment_batch(key, *found, b"".join(texts), window)

    return run


def _split(window: int, step: int):
    """Windows of split anchors, grouped by ranges of the anchor's offset and the bytes they share."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                key, asked, *parts = (c[i].as_py() for c in b.columns)
                raw = b"".join(Chunk.unpack(*parts).texts)
                view, rows = memoryview(raw), []
                for a in asked:
                    at, end, place = a["start"], a["start"] + a["windows"], a["place"]
                    while at < end:
                        part = (place - at) // step
                        to = min(end, place - part * step + 1)
                        # Every window of the range holds the bytes from its last start to its first end.
                        shared = view[place - part * step : place - part * step - step + 1 + window]
                        rows.append((at, to - at, place, _digest(shared, part + 1)))
                        at = to
                start, n, place, anchor = (np.array(c, np.int64) for c in zip(*rows))
                yield _segment_batch(key, start, n, place, anchor, raw, window)

    return run


def _fetch(window: int):
    """The bytes of the segments asked for."""
    schema = pa.schema([("anchor", pa.int64()), ("digest", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                asked, *parts = (c[i].as_py() for c in b.columns)
                raw = b"".join(Chunk.unpack(*parts).texts)
                for k in range(0, len(asked), 4096):
                    some = asked[k : k + 4096]
                    data = [raw[a["start"] : a["start"] + a["windows"] + window - 1] for a in some]
                    columns = [a["anchor"] for a in some], [a["digest"] for a in some], [a["n"] for a in some], data
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return run


def repeated_windows(text: np.ndarray, window: int, room: int = induced.ROOM) -> np.ndarray:
    """Marks at the start of every string of ``window`` characters that starts at two places of ``text``."""
    marks = np.zeros(len(text), bool)
    before = None
    for places, common in induced.suffixes(text, window, room):
        same = common >= window
        if before is not None and same[0]:
            marks[before] = True
        marks[places[same]] = True
        marks[places[:-1][same[1:]]] = True
        before = places[-1]
    return marks


_ANSWER = pa.schema([("anchor", pa.int64()), ("digest", pa.int64()), ("bits", pa.binary())])


def _shard(window: int, room: int):
    """All segments of a task: suffixes of their joined text in order, and which windows share a neighbour's."""

    def run(batches):
        file = tempfile.TemporaryFile()
        keys, at = [], 0
        for b in batches:
            anchor, digest, n = (b.column(k).to_numpy() for k in range(3))
            data = b.column(3).to_pylist()
            sizes = np.array([len(x) for x in data], np.int64)
            # Bytes from 2 on, a 1 after each segment, and a 0 at the end.
            joined = np.frombuffer(b"\x00".join(data) + b"\x00", np.uint8).astype("<u2") + 2
            ends = np.cumsum(sizes + 1)
            joined[ends - 1] = 1
            file.write(joined.tobytes())
            keys.append((anchor, digest, n, at + ends - 1 - sizes, sizes - window + 1))
            at += len(joined)
        if not keys:
            return
        file.write(np.zeros(1, "<u2").tobytes())
        file.flush()
        marks = repeated_windows(np.memmap(file, dtype="<u2", mode="r"), window, room)
        for anchor, digest, n, start, windows in keys:
            bits = [
                None if k > 1 else np.packbits(mine).tobytes() if (mine := marks[a : a + w]).any() else b""
                for k, a, w in zip(n.tolist(), start.tolist(), windows.tolist())
            ]
            found = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((anchor, digest, bits), _ANSWER)], schema=_ANSWER)
            yield found.filter(pa.array([x != b"" for x in bits]))

    return run


def covered(size: int, marks: list[dict] | None, window: int) -> np.ndarray:
    """Which bytes of a chunk the marked windows cover."""
    steps = np.zeros(size + 1, np.int64)
    for m in marks or ():
        if m["bits"] is None:
            steps[m["start"]] += 1
            steps[m["start"] + m["windows"] - 1 + window] -= 1
        else:
            bits = np.unpackbits(np.frombuffer(m["bits"], np.uint8), count=m["windows"])
            edges = np.flatnonzero(np.diff(bits, prepend=0, append=0)) + m["start"]
            np.add.at(steps, edges[::2], 1)
            np.add.at(steps, edges[1::2] + window - 1, -1)
    return np.cumsum(steps[:-1]) > 0


def _remove(window: int):
    schema = pa.schema([("doc_id", pa.int64()), *[(n, pa.int64()) for n in ("n_bytes", "n_removed", "n_spans")], ("kept", pa.binary())])

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                marks, *parts = (c[i].as_py() for c in b.columns)
                chunk = Chunk.unpack(*parts)
                gone = covered(sum(map(len, chunk.texts)), marks, window) if marks else None
                rows, held, at = [], 0, 0
                for k, text in enumerate(chunk.texts):
                    mine = gone[at : at + len(text)] if marks else None
                    at += len(text)
                    key = None if chunk.nulls[k] else int(chunk.ids[k])
                    if mine is None or not mine.any():
                        rows.append((key, len(text), 0, 0, text))
                    else:
                        spans = int(mine[0]) + int(np.count_nonzero(mine[1:] & ~mine[:-1]))
                        left = np.frombuffer(text, np.uint8)[~mine].tobytes()
                        rows.append((key, len(text), int(np.count_nonzero(mine)), spans, left))
                    held += len(rows[-1][4])
                    if held > CHUNK_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def _repeated_anchors(found: DataFrame) -> DataFrame:
    """Different segments of every anchor that occurs twice, each with its number and first place."""
    dealt = found.filter("n > 0").select("chunk", "start", "windows", "anchor", "digest", "n").repartition("anchor")
    each = dealt.groupBy("anchor", "digest").agg(
        F.sum("n").alias("n"), F.min(F.struct("chunk", "start")).alias("at"), F.first("windows").alias("windows")
    )
    mine = Window.partitionBy("anchor")
    size = F.sum(F.col("windows").cast("bigint")).over(mine)
    each = each.withColumns({"total": F.sum("n").over(mine), "texts": F.count(F.lit(1)).over(mine), "bytes": size})
    return each.filter("total > 1")


def _by_chunk(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy("chunk").agg(F.collect_list(F.struct(*columns)).alias("asked"))


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, room: int = induced.ROOM, piece: int = PIECE
) -> DataFrame:
    """Documents without the bytes covered by strings of ``window`` bytes that start at two places or more.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept, the remaining bytes. Texts
    are taken as UTF-8; matches lie inside documents; every occurrence of a repeated string goes, the first
    too. A null or empty text has no bytes. Ids are not looked at, so null and repeated ones are rows of
    their own; other columns are ignored; an empty table gives an empty result. Equal strings are told
    by 128 bits of hash where whole segments repeat and byte for byte elsewhere.
    """
    spark = docs.sparkSession
    laid = checkpointed(chunks(docs))
    found = checkpointed(laid.select("chunk", *_PARTS).mapInArrow(_cut(window, piece), _SEGMENT_DDL))
    repeats = checkpointed(_repeated_anchors(found))
    for step in [max(1, min(s, window - gram_size(window))) for s in SPLITS]:
        hot = checkpointed(repeats.filter((F.col("texts") > 1) & (F.col("bytes") > shard_bytes)).select("anchor").distinct())
        if hot.isEmpty():
            break
        asked = _by_chunk(found.join(hot, "anchor", "left_semi"), "start", "windows", "place", "anchor")
        parts = laid.join(asked, "chunk").select("chunk", "asked", *_PARTS).mapInArrow(_split(window, step), _SEGMENT_DDL)
        found = checkpointed(found.join(hot, "anchor", "left_anti").unionByName(parts))
        repeats = checkpointed(_repeated_anchors(found))
    compared = repeats.filter("texts > 1")
    total = compared.agg(F.sum(F.col("windows") + window)).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_bytes))
    asked = _by_chunk(
        compared.select("at.chunk", "at.start", "windows", "anchor", "digest", "n"), "start", "windows", "anchor", "digest", "n"
    )
    data = laid.join(asked, "chunk").select("asked", *_PARTS)
    data = data.mapInArrow(_fetch(window), "anchor bigint, digest bigint, n bigint, data binary")
    answer_ddl = "anchor bigint, digest bigint, bits binary"
    answers = data.repartition(shards, "anchor").mapInArrow(_shard(window, room), answer_ddl)
    plain = repeats.filter("texts = 1").select("anchor", "digest", F.lit(None).cast("binary").alias("bits"))
    answers = checkpointed(plain.unionByName(answers))
    marks = found.join(answers, ["anchor", "digest"]).groupBy("chunk").agg(F.collect_list(F.struct("start", "windows", "bits")).alias("marks"))
    told = laid.join(marks, "chunk", "left").select("marks", *_PARTS)
    return told.mapInArrow(_remove(window), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


#: Windows are grouped by their hash; runs of their starts are the removed bytes.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, i, md5(b[i:i + {WINDOW - 1}]) AS h FROM (SELECT r, b, unnest(range(1, octet_length(b) - {WINDOW - 2})) AS i FROM d)),
s AS (SELECT r, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
g AS (SELECT r, i, sum(CASE WHEN i <= p + {WINDOW} THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS k
  FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM s)),
runs AS (SELECT r, k, min(i) AS a, max(i) + {WINDOW - 1} AS z FROM g GROUP BY 1, 2),
cut AS (SELECT r, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z, count(*) AS n_spans, sum(z - a + 1) AS n_removed FROM runs GROUP BY 1)
SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN a IS NULL THEN b ELSE list_reduce(list_transform(range(0, len(a) + 1), lambda j: CASE
    WHEN CASE WHEN j = 0 THEN 1 ELSE z[j] + 1 END > CASE WHEN j = len(a) THEN octet_length(b) ELSE a[j + 1] - 1 END THEN ''::BLOB
    ELSE b[CASE WHEN j = 0 THEN 1 ELSE z[j] + 1 END : CASE WHEN j = len(a) THEN octet_length(b) ELSE a[j + 1] - 1 END] END), lambda x, y: x || y) END) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""
