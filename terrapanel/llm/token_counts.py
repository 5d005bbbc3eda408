"""Token counts that follow edits.

Each document keeps a segment tree over stretches of its text that end at a blank: characters
and tokens of every stretch, summed upwards. An edit finds the stretches it touches by descending
the tree, takes the next ones in as long as its end would join a word, encodes only these, and
updates the sums on the paths above them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.tokens import DEFAULT_TOKENIZER, PartEncoder
from terrapanel.llm.winnowing import identity
from terrapanel.session import checkpointed

#: Characters of a stretch, about.
STRETCH = 256
_BLANKS = (" ", "\n")
_IDENTITY = ["_key_a", "_key_b"]


def stretches(text: str, size: int = STRETCH) -> list[str]:
    """The text cut after blanks into stretches of about ``size`` characters."""
    out, at = [], 0
    while at < len(text):
        to = min(at + size, len(text))
        while to < len(text) and text[to - 1] not in _BLANKS:
            to += 1
        out.append(text[at:to])
        at = to
    return out


class SegmentTree:
    """Sums of characters and tokens over stretches; node ``i`` has children ``2i`` and ``2i + 1``."""

    def __init__(self, chars: list[int], tokens: list[int]) -> None:
        self.size = 1 << max(0, (len(chars) - 1).bit_length())
        pad = [0] * (self.size - len(chars))
        self.chars = [0] * self.size + list(chars) + pad
        self.tokens = [0] * self.size + list(tokens) + pad
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def find(self, place: int) -> tuple[int, int]:
        """The stretch that holds the character at ``place`` (the last one, past the end) and where it begins."""
        i, left = 1, min(place, max(0, self.chars[1] - 1))
        while i < self.size:
            i *= 2
            if left >= self.chars[i]:
                left -= self.chars[i]
                i += 1
        return i - self.size, min(place, max(0, self.chars[1] - 1)) - left

    def put(self, stretch: int, chars: int, tokens: int) -> None:
        i = stretch + self.size
        self.chars[i], self.tokens[i] = chars, tokens
        while i > 1:
            i //= 2
            self._sum(i)

    def leaves(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of the stretches that are not empty."""
        kept = [(c, t) for c, t in zip(self.chars[self.size :], self.tokens[self.size :]) if c]
        return [c for c, _ in kept], [t for _, t in kept]


def edit(tree: SegmentTree, text: str, start: int, removed: int, inserted: str, count) -> tuple[SegmentTree, str, int]:
    """Replace ``removed`` characters from ``start``; returns the tree, the text and how much was encoded.

    Places beyond the text are moved to its end. ``count`` gives the tokens of each of some texts.
    """
    total = len(text)
    start = min(max(start, 0), total)
    removed = min(max(removed, 0), total - start)
    first, begin = tree.find(start)
    last, at = tree.find(start + max(removed, 1) - 1)
    end = at + tree.chars[last + tree.size]
    new = text[:start] + inserted + text[start + removed :]
    while end < total:
        region_end = end + len(inserted) - removed
        if region_end <= begin or new[region_end - 1] in _BLANKS:
            break
        last, at = tree.find(end)
        end = at + tree.chars[last + tree.size]
    region = new[begin : end + len(inserted) - removed]
    if len(region) > 4 * STRETCH:  # many stretches' worth: cut it again
        chars, tokens = tree.chars[tree.size :], tree.tokens[tree.size :]
        parts = stretches(region)
        chars[first : last + 1], tokens[first : last + 1] = [len(p) for p in parts], count(parts)
        kept = [(c, t) for c, t in zip(chars, tokens) if c]
        return SegmentTree([c for c, _ in kept], [t for _, t in kept]), new, len(region)
    tree.put(first, len(region), count([region])[0])
    for i in range(first + 1, last + 1):
        if tree.chars[i + tree.size]:
            tree.put(i, 0, 0)
    return tree, new, len(region)


def build_trees(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """doc_id, identity, and ``chars`` and ``tokens`` of the stretches of every row of ``docs``."""
    schema = pa.schema([("doc_id", pa.int64()), ("_key_a", pa.int64()), ("_key_b", pa.int64()),
                        ("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])

    def build(batches):
        encoder = PartEncoder.of_worker(tokenizer)
        for b in batches:
            rows, size = [], 0
            for d, x, y, text in zip(*(c.to_pylist() for c in b.columns[:3]), b.column(3)):
                parts = stretches(text.as_py() or "")
                rows.append((d, x, y, [len(p) for p in parts], [len(ids) // 4 for ids in encoder.encode(parts)]))
                size += len(parts)
                if size > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *identity("doc_id", "text"), F.col("text").cast("string"))
    return read.mapInArrow(build, "doc_id bigint, _key_a bigint, _key_b bigint, chars array<int>, tokens array<int>")


def apply_edits(docs: DataFrame, trees: DataFrame, edits: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """Counts of every row of ``docs`` after ``edits`` (doc_id, seq, start, removed, inserted).

    Edits of a document apply in the order of seq (then start, removed, inserted), each to the
    text the one before left. Returns doc_id, n_before, n_tokens, n_edits, chars_encoded, text,
    chars and tokens. A null text is empty; null numbers are 0 and a null insertion is empty;
    places beyond the text mean its end. Edits without a document, or of a null id, do nothing;
    rows that share an id get the same edits; an empty table of documents gives an empty result.
    """
    zero = F.lit(0)
    lists = edits.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.coalesce("seq", zero).cast("bigint").alias("seq"), F.coalesce("start", zero).cast("bigint").alias("start"),
                    F.coalesce("removed", zero).cast("bigint").alias("removed"), F.coalesce("inserted", F.lit("")).alias("inserted"),
                )
            )
        ).alias("edits")
    )
    todo = trees.dropDuplicates(_IDENTITY).join(lists, "doc_id", "left").drop("doc_id")
    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *identity("doc_id", "text"), F.col("text").cast("string"))
    both = read.join(todo, _IDENTITY).select("doc_id", "text", "chars", "tokens", "edits")
    schema = pa.schema([("doc_id", pa.int64()), ("n_before", pa.int64()), ("n_tokens", pa.int64()), ("n_edits", pa.int64()),
                        ("chars_encoded", pa.int64()), ("text", pa.string()), ("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])

    def run(batches):
        encoder = PartEncoder.of_worker(tokenizer)

        def count(parts: list[str]) -> list[int]:
            return [len(ids) // 4 for ids in encoder.encode(parts)]

        for b in batches:
            rows, size = [], 0
            for i in range(b.num_rows):
                key, text, chars, tokens, todo = (c[i].as_py() for c in b.columns)
                text = text or ""
                tree = SegmentTree(chars or [0], tokens or [0])
                before, encoded = tree.tokens[1], 0
                for e in todo or ():
                    tree, text, n = edit(tree, text, e["start"], e["removed"], e["inserted"], count)
                    encoded += n
                rows.append((key, before, tree.tokens[1], len(todo or ()), encoded, text, *tree.leaves()))
                size += len(text)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return both.mapInArrow(
        run,
        "doc_id bigint, n_before bigint, n_tokens bigint, n_edits bigint, chars_encoded bigint, text string, chars array<int>, tokens array<int>",
    )


def example_edits(docs: DataFrame) -> DataFrame:
    """Three edits of every document, made from its own text: a cut, a moved stretch and a new word."""
    text = F.coalesce("text", F.lit(""))

    def place(n: int):
        return F.pmod(F.xxhash64("doc_id", F.lit(n)), F.length(text) + 1).cast("bigint")

    def one(seq: int, start: int, removed: int, inserted):
        return F.struct(F.lit(seq).alias("seq"), place(start).alias("start"), F.lit(removed).alias("removed"), inserted.alias("inserted"))

    moves = F.array(
        one(1, 1, 40, F.lit("")),
        one(2, 2, 0, F.substr(text, place(3).cast("int"), F.lit(60))),
        one(3, 4, 3, F.lit("-edited ")),
    )
    return docs.select("doc_id", F.explode(moves).alias("e")).select("doc_id", "e.*")


def counts_after_edits(docs: DataFrame, edits: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """Build the trees of ``docs``, keep them, and apply ``edits``."""
    return apply_edits(docs, checkpointed(build_trees(docs, tokenizer)), edits, tokenizer)
