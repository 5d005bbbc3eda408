"""Benchmark decontamination by winnowing, in DataFrame operations only.

From each run of ``SPAN`` windows' worth of words the smallest k-gram hash is kept, on both sides
and with the leftmost of equals, so that any shared window of 13 words shares the fingerprint at
the same place in it. Fingerprints of all documents meet those of the benchmark; around each hit
the full windows are then compared word by word. Benchmark texts shorter than a window are one
window each and are looked up by their own length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.session import checkpointed

WINDOW = 13
GRAM = 5
#: Fixed value: what a word is made of, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A position takes 30 bits, more than the words a string can hold; the hash takes the rest.
_PLACE_BITS = 30
_IDENTITY = ["_key_a", "_key_b"]


def with_identity(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of ``docs``, whatever their names) beside the row's identity."""
    return docs.select(F.struct("*").alias("row"), *identity("doc_id", "text"))


def words(text: Column) -> Column:
    """Words of a text; a null text has none."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _UPPER.lower())
    return F.regexp_extract_all(lowered, F.lit(f"({WORD})"), F.lit(1))


def identity(*columns: str) -> list[Column]:
    """128 bits that name a row by content, nulls included; equal rows get equal results."""
    values = [F.col(c) for c in columns]
    return [F.xxhash64(*values).alias("_key_a"), F.xxhash64(F.lit(7), *reversed(values)).alias("_key_b")]


def grams(w: Column, k: int) -> Column:
    """Hash of every ``k`` consecutive words."""
    n = F.size(w) - k + 1
    return F.when(n > 0, F.transform(F.slice(w, 1, n), lambda _, i: F.xxhash64(F.slice(w, i + 1, k)))).otherwise(
        F.array().cast("array<bigint>")
    )


def _fingerprints(hashes: str, gram: int, window: int) -> str:
    """SQL: places of the smallest hashes of all windows, each once, from an array of gram hashes."""
    span = window - gram + 1
    return (
        f"transform(array_distinct(transform(slice(packed, 1, greatest(size(packed) - {span - 1}, 0)), "
        f"(x, i) -> array_min(slice(packed, i + 1, {span})))), "
        f"p -> named_struct('hash', {hashes}[cast(p & {(1 << _PLACE_BITS) - 1} as int)], "
        f"'place', cast(p & {(1 << _PLACE_BITS) - 1} as int), 'size', {gram}))"
    )


def fingerprints(texts: DataFrame, sizes: list[int], gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Add ``n_words`` and ``prints`` (hash, place, size) to rows that have a column ``words``.

    ``sizes`` are lengths below a window for which every gram of that length is a fingerprint.
    """
    mask = (1 << 63 - _PLACE_BITS) - 1
    packed = texts.withColumn("n_words", F.size("words").cast("bigint")).withColumn("hashes", grams(F.col("words"), gram))
    packed = packed.withColumn(
        "packed", F.expr(f"transform(hashes, (h, i) -> shiftleft(h & {mask}L, {_PLACE_BITS}) | i)")
    )
    prints = [F.expr(_fingerprints("hashes", gram, window))]
    for size in sizes:
        prints.append(F.expr(
            f"transform(CASE WHEN size(words) >= {size} THEN sequence(0, size(words) - {size}) ELSE array() END, "
            f"i -> named_struct('hash', xxhash64(slice(words, i + 1, {size})), 'place', i, 'size', {size}))"
        ))
    return packed.withColumn("prints", F.concat(*prints)).drop("hashes", "packed")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows of the benchmark: size, body and the ids of the items that have it."""
    w = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("words"))
    w = w.filter(F.size("words") > 0).withColumn("size", F.least(F.size("words"), F.lit(window)))
    bodies = F.expr("transform(sequence(0, size(words) - size), i -> array_join(slice(words, i + 1, size), ' '))")
    each = w.select("item", "size", F.explode(bodies).alias("body"))
    return each.groupBy("size", "body").agg(F.sort_array(F.collect_set("item")).alias("items"))


def contamination(docs: DataFrame, items: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): what it shares with ``items`` (item_id, text).

    Returns doc_id, n_words, n_hit (words inside an occurrence of a window), n_items, items (ids
    as sorted strings) and the row's identity. Null texts have no words and hit nothing; null
    ids are kept (an item without id counts under the empty string, items of one id as one);
    repeated rows get equal results; either table may be empty. Other columns are ignored.
    """
    spec = checkpointed(item_windows(items, window))
    # at most ``window`` - 1 numbers
    short = sorted(r[0] for r in spec.filter(F.col("size") < window).select("size").distinct().collect())
    wanted = items.select(words(F.col("text")).alias("words")).filter(F.size("words") >= window)
    keys = fingerprints(wanted, [], gram, window).select(F.explode("prints.hash").alias("hash"), F.lit(gram).alias("size"))
    if short:
        whole = spec.filter(F.col("size") < window).select(F.xxhash64(F.split("body", " ")).alias("hash"), "size")
        keys = keys.unionByName(whole)
    keys = checkpointed(keys.select("hash", "size").distinct())
    read = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    marked = read.select("doc_id", *identity("doc_id", "text"), words(F.col("text")).alias("words"))
    prints = checkpointed(fingerprints(marked, short, gram, window).select("doc_id", *_IDENTITY, "n_words", "prints"))
    hits = (
        prints.select(*_IDENTITY, F.explode("prints").alias("p"))
        .select(*_IDENTITY, "p.*")
        .join(keys, ["hash", "size"], "left_semi")
        .groupBy(*_IDENTITY)
        .agg(F.collect_set(F.struct("size", "place")).alias("hits"))
    )
    hits = checkpointed(hits)
    # starts of the windows around each hit
    span = window - gram
    around = [
        f"flatten(transform(filter(hits, h -> h.size = {gram} AND size(words) >= {window}), h -> transform("
        f"sequence(greatest(h.place - {span}, 0), least(h.place, size(words) - {window})), "
        f"s -> named_struct('start', s, 'size', {window}))))"
    ]
    around += [f"transform(filter(hits, h -> h.size = {m}), h -> named_struct('start', h.place, 'size', {m}))" for m in short]
    found = read.select(*identity("doc_id", "text"), "text").distinct().join(hits, _IDENTITY)
    found = found.select(*_IDENTITY, "hits", words(F.col("text")).alias("words"))
    tried = found.select(*_IDENTITY, "words", F.expr(f"array_distinct(concat({', '.join(around)}))").alias("tried"))
    tried = tried.select(
        *_IDENTITY,
        F.explode(
            F.expr("transform(tried, t -> named_struct('start', t.start, 'size', t.size, "
                   "'body', array_join(slice(words, t.start + 1, t.size), ' ')))")
        ).alias("t"),
    ).select(*_IDENTITY, "t.*")
    matched = tried.join(spec, ["size", "body"])
    per_doc = matched.groupBy(*_IDENTITY).agg(
        F.collect_set(F.struct("start", "size")).alias("spans"), F.collect_set("items").alias("sets")
    )
    per_doc = per_doc.select(
        *_IDENTITY,
        F.expr("size(array_distinct(flatten(transform(spans, s -> sequence(s.start, s.start + s.size - 1)))))").cast("bigint").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten("sets"))).alias("items"),
    )
    return prints.select("doc_id", *_IDENTITY, "n_words").join(per_doc, _IDENTITY, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce(F.size("items").cast("bigint"), F.lit(0).cast("bigint")).alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        *_IDENTITY,
    )


def is_contaminated(share: int = 20) -> Column:
    """At least one word in ``share`` is hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    bad = contamination(docs, items).filter(is_contaminated()).select(*_IDENTITY).distinct()
    return with_identity(docs).join(checkpointed(bad), _IDENTITY, "left_anti").select("row.*")


ORACLE = f"""
WITH iw AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS id,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{WORD}') AS w FROM benchmark),
win AS (
  SELECT DISTINCT id, least(len(w), {WINDOW}) AS m, array_to_string(w[s + 1:s + least(len(w), {WINDOW})], ' ') AS g
  FROM (SELECT id, w, unnest(range(greatest(len(w) - {WINDOW - 1}, 1))) AS s FROM iw WHERE len(w) > 0)),
dw AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{WORD}') AS w FROM documents),
dg AS (
  SELECT r, m, s, array_to_string(w[s + 1:s + m], ' ') AS g
  FROM (SELECT r, m, w, unnest(range(len(w) - m + 1)) AS s FROM dw, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)),
hit AS (SELECT r, s, m, id FROM dg JOIN win USING (m, g)),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, s + unnest(range(m)) AS p FROM hit) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS joined
  FROM (SELECT DISTINCT r, id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(joined, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN places USING (r) LEFT JOIN ids USING (r)
"""
