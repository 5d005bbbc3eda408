"""Tables stored in buckets of their entity, so that joins and rollups on it need no shuffle.

All tables of a panel share the entity (the grid cell) in their keys. Stored in the same number of
buckets of the entity, any two of them join on (entity), (entity, year) or (entity, year, month)
bucket by bucket, and an aggregation whose keys contain the entity stays inside its bucket.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame

from terrapanel.session import release, scratch_path

#: Rows of one bucket, about, where the number of buckets is taken from the data.
BUCKET_ROWS = 4_000_000


def bucket_count(df: DataFrame, rows_per_bucket: int = BUCKET_ROWS) -> int:
    """Buckets for a table of this size, at least the session's shuffle partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows_per_bucket))


def bucketed(
    df: DataFrame, entity: str, buckets: int, sort: Sequence[str] = (), name: str | None = None, path: str | None = None
) -> DataFrame:
    """Write ``df`` as one file a bucket, sorted by the entity and ``sort``, and read it back by name.

    The files go to ``path``, by default a new one in the shared folder. Unnamed tables are scratch;
    ``drop_bucketed`` removes table and files. The session is told to accept co-partitioning by part
    of the join keys; else it would shuffle a join on (entity, year, month) of tables dealt by entity.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    scratch = path is None
    path = path or scratch_path(spark)
    name = name or f"terrapanel_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, entity)
    dealt.write.format("parquet").mode("overwrite").bucketBy(buckets, entity).sortBy(entity, *sort).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._table = name
    if scratch:
        out._stored_at = path
    return out


def drop_bucketed(*tables: DataFrame) -> None:
    """Forget scratch tables and delete their files."""
    for t in tables:
        if getattr(t, "_table", None):
            t.sparkSession.sql(f"DROP TABLE IF EXISTS {t._table}")
            release(t)


def lay_out(sources: dict[str, DataFrame | None], entity: str, buckets: int) -> dict[str, DataFrame | None]:
    """Every present source in the same buckets of the entity; equal sources are stored once."""
    stored: dict[int, DataFrame] = {}
    out: dict[str, DataFrame | None] = {}
    for name, df in sources.items():
        if df is not None and id(df) not in stored:
            order = [c for c in ("year", "month") if c in df.columns]
            stored[id(df)] = bucketed(df, entity, buckets, order)
        out[name] = None if df is None else stored[id(df)]
    return out


def exchanges(df: DataFrame) -> int:
    """Shuffles and broadcasts of the physical plan as it stands before it runs."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange" in line and "ReusedExchange" not in line for line in plan.splitlines())

