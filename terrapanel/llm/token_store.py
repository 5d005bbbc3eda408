"""Token ids written in a compact file format and read back.

Ids become ranks by descending frequency over the whole corpus, so most fit one byte. A rank is
stored in one to four bytes; two bits per rank, kept apart in control bytes of four ranks each,
say how many. Decoding looks the lengths of four ranks up in a table of 256 rows and gathers
the bytes with numpy.

A store is a folder with two Parquet tables: ``dictionary`` (rank, token_id) and ``blocks``, each
row of which holds consecutive whole documents: their ids, their token counts, the control and
the data bytes. Blocks are numbered by shard and block in ascending order of the document id;
nulls come first. Spark's committer makes the files, so a lost task leaves no partial block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.llm.tokens import DEFAULT_TOKENIZER, END_ID, PartEncoder, encoded
from terrapanel.llm.words import from_planes, planes
from terrapanel.session import checkpointed, release

#: Tokens in a block (a longer document gets a block of its own) and in a shard, roughly.
BLOCK_TOKENS = 1 << 19
SHARD_TOKENS = 1 << 24
#: Bytes of output a task holds before it passes a batch on.
HELD_BYTES = 4 << 20
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def encode_documents(ranks: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control and data bytes of each document, from the unsigned 32-bit ranks of all, one after the other."""
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    more = np.zeros(len(ranks), dtype=np.uint8)
    width = 1
    for limit in (0xFF, 0xFFFF, 0xFFFFFF):
        above = ranks > limit
        if not above.any():
            break
        more += above
        width += 1
    data = ranks.view(np.uint8).reshape(-1, 4)[:, :width][np.arange(width, dtype=np.uint8) <= more[:, None]].tobytes()
    code = np.zeros(int((sizes + 3 >> 2).sum()) * 4, dtype=np.uint8)
    code[_places(sizes)] = more
    code = code.reshape(-1, 4)
    control = (code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6).tobytes()
    upto = np.concatenate([[0], np.cumsum(more, dtype=np.int64)])
    ends = np.cumsum(sizes)
    return _cut(control, np.cumsum(sizes + 3 >> 2)), _cut(data, ends + upto[ends])


def _places(sizes: np.ndarray) -> np.ndarray:
    """Place of each rank where every document starts on a multiple of four."""
    pad = -sizes & 3
    return np.arange(int(sizes.sum())) + np.repeat(np.cumsum(pad) - pad, sizes)


def _cut(data: bytes, ends: np.ndarray) -> list[bytes]:
    ends = ends.tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def decode_documents(control: bytes, data: bytes, sizes: np.ndarray) -> np.ndarray:
    """The ranks of all documents of a block, one after the other."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[_places(sizes)]
    at = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = size > k
        if not more.any():
            break
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of one document's ranks."""
    control, data = encode_documents(ranks, np.array([len(ranks)]))
    return control[0], data[0]


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    return decode_documents(control, data, np.array([n]))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def id_type(tokenizer: str) -> str:
    """The narrowest type that holds every id."""
    return "<u2" if PartEncoder(tokenizer).vocabulary_size <= 1 << 16 else "<u4"


_IDS_DDL = "doc_id bigint, ids binary, token_id bigint, n bigint"


def document_ids(docs: DataFrame, tokenizer: str, kind: str) -> DataFrame:
    """Rows of two kinds: doc_id and ``ids`` of every document, the end id included, as byte planes; and,
    where ``ids`` is null, token_id and its occurrences in a task."""
    end = np.array([END_ID], dtype="<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("token_id", pa.int64()), ("n", pa.int64())])

    def encode(batches):
        encoder = PartEncoder.of_worker(tokenizer)
        total = np.zeros(encoder.vocabulary_size, dtype=np.int64)

        def batch(keys: list, found: list[bytes]) -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(found), "<u4")
            counts = np.bincount(ids)
            total[: len(counts)] += counts
            narrow = ids.astype(kind, copy=False)
            edges = np.cumsum([0, *(len(x) // 4 for x in found)]).tolist()
            packed = [planes(narrow[a:b]) for a, b in zip(edges, edges[1:])]
            nothing = pa.nulls(len(keys), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(packed, pa.binary()), nothing, nothing], schema=schema)

        for b in batches:
            keys, found, size = [], [], 0
            for key, ids in zip(b.column(0).to_pylist(), encoded(encoder, (x.as_py() for x in b.column(1)))):
                keys.append(key)
                found.append(ids + end)
                size += len(ids)
                if size > HELD_BYTES:
                    yield batch(keys, found)
                    keys, found, size = [], [], 0
            if keys:
                yield batch(keys, found)
        used = np.flatnonzero(total)
        columns = [pa.nulls(len(used), pa.int64()), pa.nulls(len(used), pa.binary()), pa.array(used), pa.array(total[used])]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(encode, _IDS_DDL)


def write_store(docs: DataFrame, path: str, tokenizer: str = DEFAULT_TOKENIZER, partitions: int | None = None) -> None:
    """Encode all of ``docs`` (doc_id, text) to a store at ``path``.

    A null text is empty, an empty one has the end id alone. Rows that repeat an id are stored
    side by side. No rows give a store without blocks.
    """
    spark = docs.sparkSession
    kind = id_type(tokenizer)
    both = checkpointed(document_ids(docs, tokenizer, kind))
    stored = both.filter(F.col("ids").isNotNull()).select("doc_id", "ids")
    # bounded by the vocabulary
    counts = both.filter(F.col("ids").isNull()).groupBy("token_id").agg(F.sum("n").alias("n"))
    counted = counts.orderBy(F.desc("n"), "token_id").collect()
    order = np.array([r["token_id"] for r in counted], dtype=np.int64)
    spark.createDataFrame(
        [(i, int(t)) for i, t in enumerate(order)], "rank int, token_id bigint"
    ).coalesce(1).write.parquet(f"{path}/dictionary")
    rank = np.zeros(int(order.max(initial=0)) + 1, dtype=np.uint32)
    rank[order] = np.arange(len(order))
    tokens = sum(r["n"] for r in counted)
    shards = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // SHARD_TOKENS))
    # one bound per shard, whatever the number of documents
    inner = [k / shards for k in range(1, shards)]
    cuts = stored.approxQuantile("doc_id", inner, 0.2 / shards) if shards > 1 else []
    bounds = np.array(sorted(set(cuts)), dtype=np.float64)

    def code(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("n", pa.int64()), ("control", pa.binary()), ("data", pa.binary())])
        def coded(keys: list, found: list[np.ndarray]) -> pa.RecordBatch:
            sizes = np.array([len(x) for x in found], np.int64)
            control, data = encode_documents(rank[np.concatenate(found)], sizes)
            shard = [0 if k is None else int(np.searchsorted(bounds, k, side="left")) for k in keys]
            columns = (keys, shard, sizes, control, data)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

        for b in batches:
            keys, found, size = [], [], 0
            for key, ids in zip(b.column(0).to_pylist(), b.column(1)):
                keys.append(key)
                found.append(from_planes(ids.as_py(), kind))
                size += len(found[-1])
                if size > HELD_BYTES // 4:
                    yield coded(keys, found)
                    keys, found, size = [], [], 0
            if keys:
                yield coded(keys, found)

    def to_blocks(batches):
        schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                            ("n_tokens", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())])
        state = {"shard": None, "block": 0, "start": 0}
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            ns = [r[2] for r in held]
            # each document keeps its own control bytes, so blocks are joined without decoding
            row = (state["shard"], state["block"], state["start"], [r[0] for r in held], ns, b"".join(r[3] for r in held), b"".join(r[4] for r in held))
            state["block"] += 1
            state["start"] += sum(ns)
            held.clear()
            return _batch([row], schema)

        size = 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and (row[1] != state["shard"] or size + row[2] > BLOCK_TOKENS):
                    yield flush()
                    size = 0
                if row[1] != state["shard"]:
                    state.update(shard=row[1], block=0, start=0)
                held.append(row)
                size += row[2]
        if held:
            yield flush()

    coded = stored.mapInArrow(
        code, "doc_id bigint, shard int, n bigint, control binary, data binary"
    )
    (
        coded.repartitionById(shards, "shard")
        .sortWithinPartitions("shard", "doc_id", "n", "data")
        .mapInArrow(to_blocks, "shard int, block int, start bigint, doc_ids array<bigint>, n_tokens array<bigint>, control binary, data binary")
        .write.option("compression", "zstd").parquet(f"{path}/blocks")
    )
    release(both)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a store: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit)."""
    # bounded by the vocabulary
    order = spark.read.parquet(f"{path}/dictionary").orderBy("rank").collect()
    token_of = np.array([r["token_id"] for r in order], dtype="<u4")
    blocks = spark.read.parquet(f"{path}/blocks")
    size = F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x)
    # one row per shard, of millions of tokens each
    totals = blocks.groupBy("shard").agg(F.max(F.col("start") + size).alias("total")).orderBy("shard").collect()
    before = dict(zip((r["shard"] for r in totals), np.cumsum([0, *(r["total"] for r in totals)]).tolist()))

    def decode(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for b in batches:
            for i in range(b.num_rows):
                shard, start, keys, ns, control, data = (c[i].as_py() for c in b.columns)
                if not keys:
                    continue
                sizes = np.array(ns, np.int64)
                ids = token_of[decode_documents(control, data, sizes)].tobytes()
                ends = np.cumsum(sizes)
                columns = (keys, start + before[shard] + ends - sizes, ns, _cut(ids, 4 * ends))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return blocks.select("shard", "start", "doc_ids", "n_tokens", "control", "data").mapInArrow(
        decode, "doc_id bigint, start bigint, n_tokens bigint, ids binary"
    )
