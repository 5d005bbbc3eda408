"""Best-fit packing planned on the histogram of lengths.

The plan is made from the number of pieces of every length, never from the pieces: best fit in
descending order of length puts whole runs of equal pieces into runs of equally full sequences.
Its size depends on the capacity alone. Pieces then take their places by their rank within
their length: a rank inside the task that encoded them plus the count of earlier tasks, so no
length, however common, is gathered anywhere.
"""

from __future__ import annotations

import bisect
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrapanel.llm.tokens import DEFAULT_TOKENIZER, END_ID, PartEncoder, encoded
from terrapanel.session import checkpointed

CAPACITY = 4096
OUTPUT_ROWS = 20_000


@dataclass
class Plan:
    """Runs of places: ``n`` pieces of ``length`` from rank ``rank``, ``per`` in each sequence.

    Piece ``i`` of a run stands in sequence ``sequence + i // per`` at ``offset + i % per * length``.
    """

    length: np.ndarray
    rank: np.ndarray
    n: np.ndarray
    per: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def first_run(self, capacity: int) -> np.ndarray:
        return np.searchsorted(self.length, np.arange(capacity + 2))

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces given by their length and rank within it."""
        at = np.empty(len(length), dtype=np.int64)
        for one in np.unique(length):
            lo, hi = np.searchsorted(self.length, [one, one + 1])
            mine = length == one
            at[mine] = lo + np.searchsorted(self.rank[lo:hi], rank[mine], side="right") - 1
        i = rank - self.rank[at]
        return self.sequence[at] + i // self.per[at], self.offset[at] + i % self.per[at] * self.length[at]


def plan_best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Place ``counts[length]`` pieces of each length, longest first, where they fit most tightly."""
    runs = []
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> (first sequence, how many)
    free: list[int] = []  # the keys of room, ascending
    made = 0

    def put_back(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                room[left] = []
                bisect.insort(free, left)
            room[left].append((first, n))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit {capacity}")
        todo, rank = counts[length], 0
        while todo:
            k = bisect.bisect_left(free, length)
            if k < len(free):
                left = free[k]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left]
                    free.pop(k)
            else:
                left, first, n = capacity, made, -(-todo // (capacity // length))
                made += n
            per, offset = left // length, capacity - left
            full = min(n, todo // per)
            if full:
                runs.append((length, rank, full * per, per, first, offset))
                put_back(left - per * length, first, full)
                rank, todo = rank + full * per, todo - full * per
            if todo and full < n:  # fewer than a sequence takes
                runs.append((length, rank, todo, todo, first + full, offset))
                put_back(left - todo * length, first + full, 1)
                full, todo = full + 1, 0
            put_back(left, first + full, n - full)
    runs.sort()
    columns = np.array(runs, dtype=np.int64).reshape(-1, 6).T.copy()
    return Plan(*columns, sequences=made)


def token_pieces(
    docs: DataFrame,
    tokenizer: str = DEFAULT_TOKENIZER,
    capacity: int = CAPACITY,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document, each with its end id.

    Every row is one document: repeated ids give repeated pieces, and a null id is kept. A null
    or empty text is the end id alone. ``task`` and ``task_rank`` number equal lengths per task.
    """
    def cut(batches):
        encoder = PartEncoder.of_worker(tokenizer)
        end = np.array([END_ID], dtype="<u4").tobytes()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        task = TaskContext.get().partitionId()
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[]] * len(schema)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

        for b in batches:
            for key, ids in zip(b.column(0).to_pylist(), encoded(encoder, (x.as_py() for x in b.column(1)))):
                ids += end
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    n = len(part) // 4
                    row = (key, piece, start // 4, n, zlib.crc32(part), task, int(seen[n]))
                    rows.append((*row, part) if with_ids else row)
                    seen[n] += 1
                if len(rows) >= (200 if with_ids else OUTPUT_ROWS):
                    yield batch()
            yield batch()

    kind = docs.schema[id_column].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    fields = [("doc_id", arrow), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
              ("ids_crc32", pa.int64()), ("task", pa.int32()), ("task_rank", pa.int64())]
    ddl = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, task_rank bigint"
    if with_ids:
        fields.append(("ids", pa.binary()))
        ddl += ", ids binary"
    schema = pa.schema(fields)
    return docs.select(F.col(id_column), F.col(text_column).cast("string")).mapInArrow(cut, ddl)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every stored piece (see ``token_pieces``) its ``sequence_id`` and ``offset``.

    ``pieces`` must be a stored table: its task ranks are read more than once.
    """
    per_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # one row per length that occurs, so at most ``capacity`` rows
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_best_fit(counts, capacity)
    ranked = pieces.join(base, ["length", "task"]).withColumn("rank", F.col("before") + F.col("task_rank"))
    kept = [c for c in pieces.columns if c not in ("task", "task_rank")]
    columns = [*kept, "rank"]

    def place(batches):
        for b in batches:
            sequence, offset = plan.places(
                b.column(kept.index("length")).to_numpy(), b.column(len(kept)).to_numpy()
            )
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(kept)], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                names=[*kept, "sequence_id", "offset"],
            )

    kinds = dict(pieces.dtypes)
    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", sequence_id bigint, offset bigint"
    return ranked.select(*columns).mapInArrow(place, ddl)


def pack_documents(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, capacity: int = CAPACITY, **names) -> DataFrame:
    """Cut, plan and place: one row per piece with its sequence and its place there.

    An empty table gives an empty result; columns of ``docs`` other than id and text are ignored.
    """
    return pack(checkpointed(token_pieces(docs, tokenizer, capacity, **names)), capacity)
