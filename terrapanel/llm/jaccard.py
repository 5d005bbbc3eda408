"""Similarity join of documents on the Jaccard index of their word n-grams, by MinHash banding.

Documents with the same n-gram set form a class and are handled as one. Bands of MinHash values,
as many as the wanted recall asks for, bring similar classes together: each bucket links its
members to its least one, and the linked groups are then verified on the full sets. A group is
cut into tiles of bounded size, by set size where it is large, and a tile counts its pairs as a
matrix product, so no pair is ever a row.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.components import components
from terrapanel.llm.winnowing import identity, with_identity
from terrapanel.llm.words import WordHashes, mixed, window_hash
from terrapanel.llm.words import REMEMBERED_WORDS
from terrapanel.session import checkpointed

GRAM = 5
THRESHOLD = 0.8
RECALL = 0.9999
ROWS = 6
#: Most classes of a tile's side.
TILE = 512
_COLUMNS = 4096
_IDENTITY = ["_key_a", "_key_b"]
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def band_count(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of ``rows`` values that bring a pair at the threshold together with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def gram_set(text: str | None, gram: int, known: WordHashes) -> np.ndarray:
    """Sorted hashes of the n-grams of the lower-cased words; a shorter text is one n-gram."""
    words = _WORD.findall((text or "").encode().lower())
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(known) > REMEMBERED_WORDS:
        known.clear()
    hashes = np.frombuffer(b"".join(map(known.__getitem__, words)), dtype="<u8").reshape(-1, 2)
    return np.unique(window_hash(hashes, min(gram, len(words)), 0))


def set_hash(grams: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(grams.tobytes()), "<i8").tolist())


def min_hash_bands(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per set (not empty) and band."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), bands), dtype=np.uint64)
    factor = 0x9E3779B97F4A7C15
    scratch = np.empty_like(flat)
    for band in range(bands):
        key = np.full(len(sets), band + 1, dtype=np.uint64)
        for _ in range(rows):
            factor = (factor * 0x5851F42D4C957F2D + 0x14057B7EF767814F) & (1 << 64) - 1
            np.multiply(flat, np.uint64(factor | 1), out=scratch)
            np.bitwise_xor(scratch, np.uint64(factor >> 1), out=scratch)
            key = mixed(key ^ np.minimum.reduceat(scratch, starts)) + np.uint64(band)
        out[:, band] = key
    return out


def signatures(docs: DataFrame, gram: int, bands: int, rows: int) -> DataFrame:
    """Per row: doc_id, identity, size of its set, the set's hash and band keys (null if empty)."""
    schema = pa.schema([("doc_id", pa.int64()), ("_key_a", pa.int64()), ("_key_b", pa.int64()), ("size", pa.int32()),
                        ("h1", pa.int64()), ("h2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def sign(batches):
        known = WordHashes()

        def rows_of(held):
            sets = [s for *_, s in held if len(s)]
            keys = iter(min_hash_bands(sets, bands, rows).view(np.int64).tolist() if sets else ())
            out = [(d, a, b, len(s), *(set_hash(s) if len(s) else (None, None)), next(keys) if len(s) else None) for d, a, b, s in held]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

        for batch in batches:
            held, total = [], 0
            for d, a, b, text in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3)):
                held.append((d, a, b, gram_set(text.as_py(), gram, known)))
                total += len(held[-1][-1])
                if total > 200_000:
                    yield rows_of(held)
                    held, total = [], 0
            if held:
                yield rows_of(held)

    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *identity("doc_id", "text"), F.col("text").cast("string"))
    return read.mapInArrow(sign, "doc_id bigint, _key_a bigint, _key_b bigint, size int, h1 bigint, h2 bigint, bands array<bigint>")


def bucket_edges(classes: DataFrame) -> DataFrame:
    """Each class with the least class of every bucket it is in."""
    keys = classes.select("node", F.explode("bands").alias("bucket"))
    hubs = keys.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("top")).filter("low != top").select("bucket", "low")
    return keys.join(hubs, "bucket").filter("node != low").select(F.col("node").alias("high"), "low").distinct()


def _tiles(members: DataFrame, threshold: float, tile: int) -> DataFrame:
    """Give every member its tiles; two members that can be similar share exactly one.

    A group of up to ``tile`` is one tile. In a larger one, sizes are classed so that only equal
    and neighbouring classes can be similar, and each class is dealt out to sides by hash.
    """
    members = members.withColumn("class", F.floor(F.log(F.col("size").cast("double")) / math.log(1 / threshold) + 1e-9))
    counts = checkpointed(members.groupBy("component", "class").agg(F.count(F.lit(1)).alias("n")))
    whole = counts.groupBy("component").agg(F.sum("n").alias("group_n"))
    sides = counts.select("component", "class", F.ceil(F.col("n") / tile).cast("int").alias("sides"))
    below = sides.select("component", (F.col("class") + 1).alias("class"), F.col("sides").alias("below"))
    above = sides.select("component", (F.col("class") - 1).alias("class"), F.col("sides").alias("above"))
    spec = sides.join(below, ["component", "class"], "left").join(above, ["component", "class"], "left").join(whole, "component")
    spec = spec.na.fill(0, ["below", "above"])
    dealt = members.join(spec, ["component", "class"]).withColumn("side", F.pmod(F.xxhash64("node"), F.col("sides")).cast("int"))
    cells = F.expr(
        f"""CASE WHEN group_n <= {tile} THEN array(named_struct('c', 0L, 'a', -1, 'b', 0, 'first', true)) ELSE concat(
          transform(sequence(0, sides - 1), t -> named_struct('c', 2 * class, 'a', least(side, t), 'b', greatest(side, t), 'first', true)),
          CASE WHEN above = 0 THEN array() ELSE transform(sequence(0, above - 1), t -> named_struct('c', 2 * class + 1, 'a', side, 'b', t, 'first', true)) END,
          CASE WHEN below = 0 THEN array() ELSE transform(sequence(0, below - 1), t -> named_struct('c', 2 * class - 1, 'a', t, 'b', side, 'first', false)) END) END"""
    )
    return dealt.select("component", "node", "side", "copies", "doc_id", "h1", "h2", F.explode(cells).alias("t")).select(
        "component", "t.*", "node", "side", "copies", "doc_id", "h1", "h2"
    )


def _linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Whether each two of the sets are similar, from the product of their incidence matrix."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(n), sizes)
    values, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = column.reshape(-1)
    often = counts > 1
    at = np.cumsum(often) - 1
    use = often[column]
    owner, column = owner[use], at[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((n, n), dtype=np.float64)
    for first in range(0, int(often.sum()), _COLUMNS):
        lo, hi = np.searchsorted(column, [first, first + _COLUMNS])
        part = np.zeros((n, _COLUMNS), dtype=np.float32)
        part[owner[lo:hi], column[lo:hi] - first] = 1
        common += part @ part.T
    share = Fraction(str(threshold))
    common = np.rint(common).astype(np.int64)
    out = common * (share.numerator + share.denominator) >= share.numerator * (sizes[:, None] + sizes[None, :])
    np.fill_diagonal(out, False)
    return out


def _verify(threshold: float):
    """For sorted rows of tiles: per class its links there and its least linked class."""
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("linked_documents", pa.int64()), ("least", pa.int64())])

    def close(key, rows):
        c, a, b = key[1], key[2], key[3]
        one = {r[0]: r for r in rows}
        nodes = sorted(one)
        if len(nodes) < 2:
            return None
        similar = _linked([one[x][3] for x in nodes], threshold)
        if a >= 0:
            # within a class each pair counts in the tile of its two sides; across, only low with high
            label = np.array([one[x][4] if c % 2 == 0 else int(one[x][1]) for x in nodes])
            differ = label[:, None] != label[None, :]
            if c % 2 or a != b:
                similar &= differ
        linked = similar.any(axis=1)
        if not linked.any():
            return None
        ids, copies = np.array(nodes), np.array([one[x][2] for x in nodes])
        # spanning links: each class to the least of its part of the tile
        least = ids.copy()
        while True:
            lower = np.where(similar, least[None, :], least[:, None]).min(axis=1)
            lower = np.minimum(lower, least)
            if (lower == least).all():
                break
            least = lower
        rows = (ids[linked], similar.sum(axis=1)[linked], (similar * copies[None, :]).sum(axis=1)[linked], least[linked])
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], schema=schema)

    def run(batches):
        key, rows = None, []
        for batch in batches:
            for component, c, a, b, first, node, side, copies, grams in zip(*(x.to_pylist() for x in batch.columns)):
                now = (component, c, a, b)
                if now != key:
                    if rows and (out := close(key, rows)) is not None:
                        yield out
                    key, rows = now, []
                rows.append((node, first, copies, np.frombuffer(grams, "<u8"), side))
        if rows and (out := close(key, rows)) is not None:
            yield out

    return run


def link(docs: DataFrame, gram: int = GRAM, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, tile: int = TILE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): class_id, n_links, and more.

    class_id is the least doc_id among the documents that links join to it, directly or not, and
    n_links how many documents have a Jaccard index of ``threshold`` or more with it. set_id
    tells documents with equal n-gram sets. A text without words (null too) has no n-grams, no
    links and its own id as class; fewer than ``gram`` words are one n-gram. Null ids are
    ordered last and are null in class_id only if the whole class has none. Repeated rows count
    as documents each. An empty table gives an empty result, other columns are ignored.
    """
    bands = band_count(threshold, recall, rows)
    signed = checkpointed(signatures(docs, gram, bands, rows))
    # the row of the least id stands for its class, null ids last
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *_IDENTITY)
    classes = signed.filter("size > 0").groupBy("h1", "h2").agg(
        F.min(place).alias("row"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands")
    )
    classes = classes.select("h1", "h2", "row.doc_id", *[F.col(f"row.{c}") for c in _IDENTITY], "copies", "size", "bands")
    classes = checkpointed(classes.withColumn("node", F.monotonically_increasing_id()))
    groups = checkpointed(components(bucket_edges(classes)))
    members = groups.join(classes.drop("bands"), "node")
    tiles = _tiles(checkpointed(members.drop(*_IDENTITY)), threshold, tile)
    texts = docs.select(*identity("doc_id", "text"), F.col("text").cast("string").alias("text"))
    wanted = members.select("node", *_IDENTITY, "h1", "h2")
    # a class's text is that of its row, found by what names it; the hash of the set confirms it
    sets = texts.join(wanted.hint("merge"), _IDENTITY).select("node", "h1", "h2", "text")

    def grams_of(batches):
        known = WordHashes()
        for batch in batches:
            out = []
            for node, h1, h2, text in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3)):
                grams = gram_set(text.as_py(), gram, known)
                if len(grams) and set_hash(grams) == (h1, h2):
                    out.append((node, grams.tobytes()))
                if len(out) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary()))], names=["node", "grams"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary()))], names=["node", "grams"])

    sets = sets.mapInArrow(grams_of, "node bigint, grams binary")
    sent = tiles.join(sets, "node").select("component", "c", "a", "b", "first", "node", "side", "copies", "grams")
    dealt = sent.repartition("component", "c", "a", "b").sortWithinPartitions("component", "c", "a", "b")
    found = checkpointed(dealt.mapInArrow(_verify(threshold), "node bigint, links bigint, linked_documents bigint, least bigint"))
    joined = components(found.select(F.col("node").alias("high"), F.col("least").alias("low")))
    linked = found.groupBy("node").agg(F.sum("linked_documents").alias("linked"))
    facts = classes.select("node", "h1", "h2", "doc_id", "copies").join(linked, "node", "left").join(joined, "node", "left")
    facts = checkpointed(facts.withColumn("component", F.coalesce("component", "node")))
    least = facts.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    facts = facts.join(least, "component").select(
        "h1", "h2", "node", "component", "class_id", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")
    )
    return signed.select("doc_id", *_IDENTITY, "h1", "h2").join(facts, ["h1", "h2"], "left").select(
        "doc_id",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        F.col("node").alias("set_id"),
        "component",
        *_IDENTITY,
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class: that of the least id (null last), and all without words.

    All columns pass through. Of repeated rows one stays, if they have words.
    """
    linked = checkpointed(link(docs, **options).filter(F.col("component").isNotNull()).select("component", "doc_id", *_IDENTITY))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *_IDENTITY)
    first = linked.groupBy("component").agg(F.min(rank).alias("first")).select("component", "first.*")
    first = first.select("component", F.col("_key_a").alias("_a"), F.col("_key_b").alias("_b"))
    gone = linked.join(first, "component").filter("_key_a != _a OR _key_b != _b").select(*_IDENTITY).distinct()
    kept = with_identity(docs).join(checkpointed(gone).hint("merge"), _IDENTITY, "left_anti")
    twice = checkpointed(linked.groupBy(*_IDENTITY).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(*_IDENTITY))
    if not twice.isEmpty():
        repeated = kept.join(twice, _IDENTITY, "left_semi").dropDuplicates(_IDENTITY)
        kept = kept.join(twice, _IDENTITY, "left_anti").unionByName(repeated)
    return kept.select("row.*")
