"""Removal of repeated runs of lines, in DataFrame operations only.

A line ends a chunk where a rolling hash over the hashes of it and the line before meets a
condition that the line before did not meet, so chunks have two lines at least. Boundaries
depend on three lines of content, not on their place: a passage moved within or between
documents is cut alike after its first boundary. Chunks of several lines that
occur more than once are then compared byte by byte, and all but the first occurrence go.

A chunk needs both of its cuts inside the repeated passage. With ``whole`` every two neighbouring
lines are looked at besides the chunks, so a passage goes up to its last equal line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.winnowing import identity, with_identity
from terrapanel.session import checkpointed

#: One line in so many meets the condition, on average.
SPACING = 2
#: Lines with more than blanks that a chunk needs to be looked at.
LEAST_LINES = 2
# Multiplier and modulus of the rolling hash.
_TIMES, _MODULUS = 1_000_003, 1_000_000_007
_IDENTITY = ["_key_a", "_key_b"]


def split_lines(text: Column) -> Column:
    """Lines of a text between line feeds; a null text is one empty line."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def line_chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``lines`` and ``chunks`` (start, n, body), which cover all lines in order."""
    cut = docs.withColumn("lines", split_lines(F.col(text)))
    cut = cut.withColumn("h", F.transform("lines", lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("bigint")))
    meets = "(h[{0} - 2] * %d + h[{0} - 1]) %% %d %% %d = 0" % (_TIMES, _MODULUS, SPACING)
    starts = (
        f"filter(sequence(0, size(lines) - 1), i -> i = 0 OR (i > 1 AND {meets.format('i')} "
        f"AND (i = 2 OR NOT {meets.format('(i - 1)')})))"
    )
    cut = cut.withColumn("starts", F.expr(starts))
    chunks = (
        "transform(starts, (s, j) -> named_struct('start', s, 'n', coalesce(get(starts, j + 1), size(lines)) - s, "
        "'body', array_join(slice(lines, s + 1, coalesce(get(starts, j + 1), size(lines)) - s), '\n')))"
    )
    return cut.withColumn("chunks", F.expr(chunks)).drop("h", "starts")


def line_windows(docs: DataFrame) -> DataFrame:
    """Add ``windows`` (start, n): any two lines with more than blanks that have at most blank lines between them.

    A run of lines that occurs before is made of windows that occur before, wherever its cuts are.
    """
    cut = docs.withColumn("full", F.expr("filter(sequence(0, size(lines) - 1), i -> trim(lines[i]) <> '')"))
    windows = "transform(slice(full, 2, size(full)), (e, j) -> named_struct('start', full[j], 'n', e - full[j] + 1))"
    return cut.withColumn("windows", F.expr(windows)).drop("full")


def _several(body: Column) -> Column:
    """Whether the chunk has enough lines that are not blank."""
    return F.size(F.filter(F.split(body, "\n", -1), lambda x: F.trim(x) != "")) >= LEAST_LINES


def _hashed(docs: DataFrame, whole: bool) -> DataFrame:
    """hash, identity, start and n of all runs of lines that are looked at."""
    # every text has a chunk; a plain explode would infer a filter that derives all of them again
    cut = line_chunks(docs)
    chunks = cut.select("doc_id", *_IDENTITY, F.explode_outer("chunks").alias("c")).select("doc_id", *_IDENTITY, "c.*")
    chunks = chunks.filter((F.col("n") >= LEAST_LINES) & _several(F.col("body")))
    chunks = chunks.select(F.xxhash64("body").alias("hash"), *_IDENTITY, "start", "n")
    if not whole:
        return chunks
    # hashed before they become rows, so that no line is copied into two of them
    each = "transform(windows, w -> named_struct('hash', xxhash64(array_join(slice(lines, w.start + 1, w.n), '\n')), 'start', w.start, 'n', w.n))"
    windows = line_windows(docs.withColumn("lines", split_lines(F.col("text")))).select(*_IDENTITY, F.explode_outer(F.expr(each)).alias("w"))
    windows = windows.filter("w IS NOT NULL").select("w.hash", *_IDENTITY, "w.start", "w.n")
    return chunks.unionByName(windows)


def repeated_chunks(docs: DataFrame, whole: bool = False) -> DataFrame:
    """Occurrences to remove: the row's identity and ``gone``, its runs (start, n) in order.

    The first occurrence, by document id (null first) and then by place, stays. Rows that agree
    in id and text are one document. With ``whole`` the runs may overlap, one that overlaps its own
    first occurrence stays, and documents of one id are ordered by their identity.
    """
    each = docs.select("doc_id", *identity("doc_id", "text"), "text")
    # hashes that occur more than once, found on narrow rows and combined before they are shuffled
    seen = checkpointed(_hashed(each, whole))
    often = seen.groupBy("hash").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("hash")
    asked = seen.join(often, "hash", "left_semi").groupBy(*_IDENTITY).agg(F.collect_set(F.struct("start", "n", "hash")).alias("asked"))
    asked = checkpointed(asked)
    # bodies of these alone are read again; both sides grow with the corpus, so neither is broadcast
    bodies = each.join(asked.hint("merge"), _IDENTITY).select("doc_id", *_IDENTITY, split_lines(F.col("text")).alias("lines"), "asked")
    # two uses of the lines keep the optimizer from splitting the text again for every chunk
    cut = "named_struct('start', c.start, 'n', c.n, 'hash', c.hash, 'body', array_join(slice(lines, c.start + 1, least(c.n, size(lines))), '\n'))"
    bodies = bodies.select("doc_id", *_IDENTITY, F.explode_outer(F.expr(f"transform(asked, c -> {cut})")).alias("c"))
    alike = checkpointed(bodies.select("doc_id", *_IDENTITY, "c.*"))
    # bytes decide: the group is the body itself
    place = F.struct("doc_id", *(_IDENTITY if whole else ()), "start")
    first = alike.groupBy("hash", "body").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    first = checkpointed(first.filter(~F.col("first").eqNullSafe(F.col("last"))).select("hash", "body", "first"))
    stays = place.eqNullSafe(F.col("first"))
    if whole:
        same = [F.col(k) == F.col(f"first.{k}") for k in _IDENTITY]
        stays = same[0] & same[1] & (F.col("start") < F.col("first.start") + F.col("n"))
    gone = alike.join(first, ["hash", "body"]).filter(~stays)
    return gone.groupBy(*_IDENTITY).agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("gone"))


def remove_repeated_lines(docs: DataFrame, counts: bool = True, whole: bool = False) -> DataFrame:
    """``docs`` with the remaining lines as ``text``, and with ``n_lines`` and ``n_removed``.

    Needs doc_id and text; other columns pass through, but the two counts replace columns of
    their names (``counts=False`` leaves them out). A null text stays null and an empty one
    empty; a document whose lines all go keeps its row with an empty text. ``whole`` removes any
    run of two lines or more that occurs before, not only those that are chunks.
    """
    gone = checkpointed(repeated_chunks(docs, whole))
    if whole:  # overlapping runs become runs of one line each
        each_line = "sort_array(array_distinct(flatten(transform(gone, g -> sequence(g.start, g.start + g.n - 1)))))"
        gone = gone.withColumn("gone", F.expr(f"transform({each_line}, i -> named_struct('start', i, 'n', 1))"))
    marked = with_identity(docs).join(gone.hint("merge"), _IDENTITY, "left").withColumn("lines", split_lines(F.col("row.text")))
    kept = (
        "flatten(transform(sequence(0, size(gone)), j -> slice(lines, "
        "CASE WHEN j = 0 THEN 1 ELSE gone[j - 1].start + gone[j - 1].n + 1 END, "
        "CASE WHEN j = size(gone) THEN size(lines) ELSE gone[j].start END - "
        "CASE WHEN j = 0 THEN 0 ELSE gone[j - 1].start + gone[j - 1].n END)))"
    )
    left = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.expr(kept), "\n"))
    columns = [left.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    if not counts:
        return marked.select(*columns)
    removed = F.aggregate("gone", F.lit(0).cast("bigint"), lambda a, g: a + g["n"])
    names = ("n_lines", "n_removed")
    return marked.select(
        *(x for x, c in zip(columns, docs.columns) if c not in names),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.coalesce(removed, F.lit(0).cast("bigint")).alias("n_removed"),
    )


ORACLE = f"""
WITH l AS (
  SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
x AS (SELECT doc_id, text, generate_subscripts(lines, 1) - 1 AS i, unnest(lines) AS line FROM l),
h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h FROM x),
m AS (
  SELECT *, i > 1 AND (lag(h, 2) OVER w * {_TIMES} + lag(h) OVER w) % {_MODULUS} % {SPACING} = 0 AS m
  FROM h WINDOW w AS (PARTITION BY doc_id, text ORDER BY i)),
b AS (
  SELECT *, CASE WHEN i = 0 OR (m AND NOT lag(m) OVER (PARTITION BY doc_id, text ORDER BY i)) THEN 1 ELSE 0 END AS b FROM m),
g AS (SELECT *, sum(b) OVER (PARTITION BY doc_id, text ORDER BY i) AS k FROM b),
c AS (
  SELECT doc_id, text, k, min(i) AS s, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body,
    count(*) FILTER (WHERE trim(line) <> '') >= {LEAST_LINES} AS several FROM g GROUP BY 1, 2, 3),
f AS (
  SELECT *, rank() OVER (PARTITION BY body ORDER BY doc_id NULLS FIRST, s) > 1 AND several AS gone FROM c),
t AS (
  SELECT doc_id, text, sum(n) AS n_lines, coalesce(sum(n) FILTER (WHERE gone), 0) AS n_removed,
    coalesce(string_agg(body, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '') AS kept FROM f GROUP BY 1, 2)
SELECT d.doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, sha256(kept) AS text_sha256
FROM documents d JOIN t ON d.doc_id IS NOT DISTINCT FROM t.doc_id AND d.text = t.text
"""
