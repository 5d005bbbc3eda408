"""Alignment of the tokens of two tokenizers, with corpus-wide counts of linked id pairs.

Both tokenizers end a token before any blank that follows another character, so a text falls into
parts that both encode alone, and all that alignment says of a part (tokens, groups, links) is
worked out once a worker. Documents are laid in blocks. A block writes, for each id pair linked in
it, a posting: the set of its documents, as a bitmap or as a list of places, whichever is shorter,
and planes that hold the bits of the number of links each of them has. The sets of a pair over all
blocks are disjoint pieces of one bitmap, so their OR has the sum of their popcounts, which is the
pair's document count. Postings then return to their blocks with count and rank of their pair,
and every document adds up what its links are worth.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.tokens import worker_shelf
from terrapanel.session import checkpointed

BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Documents and characters of a block, whichever is reached first. A place is 16 bits.
BLOCK_DOCS = 1 << 13
BLOCK_CHARS = 4 << 20
#: Parts encoded in one string.
TOGETHER = 256
#: Parts, and bytes of parts, that a worker remembers before it starts afresh.
REMEMBERED_PARTS = 250_000
REMEMBERED_BYTES = 8 << 20
_BLANK = "▁"
_CUT = re.compile(r"(?<=\S) (?=[\s\S])")


def byte_level_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def parts_of(text: str) -> list[str]:
    """The text, which begins with a blank, cut before each blank that follows a non-blank and is not the last character."""
    pieces = _CUT.split(text)
    return [pieces[0], *[" " + p for p in pieces[1:]]]


class Aligner:
    """Both tokenizers, with what a worker has worked out of the parts it has met."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        letters = byte_level_alphabet()
        known_a = {i: bytes(letters[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.bytes_a = [known_a.get(i, b"") for i in range(max(self.a.get_vocab().values()) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        as_byte = re.compile(r"<0x([0-9A-F]{2})>")
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := as_byte.fullmatch(p)) else p.replace(_BLANK, " ").encode() for p in pieces]
        # Only where no piece goes on past a blank do parts encode alone.
        self.divisible = not any(re.search(f"[^{_BLANK}]{_BLANK}", p) for p in pieces)
        self.size_a, self.size_b = (np.array([len(x) for x in y], np.int64) for y in (self.bytes_a, self.bytes_b))
        ids = max(len(self.bytes_a), len(self.bytes_b))
        # How an id is shown inside a group, and as the last of its side.
        self.shown_as = [np.array([f"{i}{mark}" for i in range(ids)], object) for mark in (",", "|", ";")]
        self.forget()

    @classmethod
    def of_worker(cls, path_a: str, path_b: str) -> Aligner:
        shelf = worker_shelf()
        if ("aligner", path_a, path_b) not in shelf:
            shelf["aligner", path_a, path_b] = cls(path_a, path_b)
        return shelf["aligner", path_a, path_b]

    def forget(self) -> None:
        """Numbers of parts, and by number: counts (a, b, groups, links, bad), groups, and links as numbers of pairs."""
        self.number: dict[str, int] = {}
        self.counts = np.zeros((0, 5), np.int64)
        self.shown: list[str] = []
        self.links = np.zeros(0, np.int32)
        self.pair_number: dict[int, int] = {}
        self.held = 0

    def _bad(self, parts: list[bytes], ids: np.ndarray, sizes: np.ndarray, table: list[bytes]) -> np.ndarray:
        """Which parts their tokens do not give back byte for byte."""
        out, ends = np.zeros(len(parts), bool), np.cumsum(sizes).tolist()
        for k, (raw, lo, hi) in enumerate(zip(parts, [0, *ends], ends)):
            out[k] = b"".join([table[i] for i in ids[lo:hi].tolist()]) != raw
        return out

    def _learn(self, parts: list[str]) -> None:
        raw = [p.encode() for p in parts]
        at = np.cumsum([len(x) for x in raw])
        # Parts are cut where tokens end, so several in a row encode as each alone, unless one ends in a blank.
        stops = sorted({*range(0, len(parts), TOGETHER), *(k + 1 for k, p in enumerate(parts) if p[-1].isspace()), len(parts)})
        found_a = self.a.encode_batch_fast(["".join(parts[i:j]) for i, j in zip(stops, stops[1:])], add_special_tokens=False)
        a = np.fromiter(chain.from_iterable(e.ids for e in found_a), np.int64)
        n_a = np.diff(np.searchsorted(np.cumsum(self.size_a[a]), at, side="right"), prepend=0)
        found_b = self.b.encode([p[1:] for p in parts], num_threads=1)
        b = np.fromiter(chain.from_iterable(found_b), np.int64)
        n_b = np.array([len(x) for x in found_b], np.int64)
        whole = b"".join(raw)
        bad = np.zeros(len(parts), bool)
        for ids, n, size, table in ((a, n_a, self.size_a, self.bytes_a), (b, n_b, self.size_b, self.bytes_b)):
            ends = np.concatenate([[0], np.cumsum(size[ids])])[np.cumsum(n)]
            if not np.array_equal(ends, at) or b"".join([table[i] for i in ids.tolist()]) != whole:
                bad |= self._bad(raw, ids, n, table)
        a, b = a[~np.repeat(bad, n_a)], b[~np.repeat(bad, n_b)]
        n_a[bad] = n_b[bad] = 0
        of_a, of_b = (np.repeat(np.arange(len(parts)), n) for n in (n_a, n_b))
        first_a, first_b, pair_part, last_a, last_b = align(self.size_a[a], self.size_b[b], of_a)
        numbers = self._pair_numbers(a[first_a] << 32 | b[first_b])
        group_a, group_b = (np.cumsum(x) - x for x in (last_a, last_b))
        show = np.concatenate([
            np.where(last_a, self.shown_as[1][a], self.shown_as[0][a]), np.where(last_b, self.shown_as[2][b], self.shown_as[0][b])
        ])[np.lexsort((np.repeat([0, 1], [len(a), len(b)]), np.concatenate([group_a, group_b])))].tolist()
        ends = np.cumsum(n_a + n_b).tolist()
        self.number.update(zip(parts, range(len(self.shown), len(self.shown) + len(parts))))
        self.shown += ["".join(show[lo:hi]) for lo, hi in zip([0, *ends], ends)]
        n_groups = np.bincount(of_a[last_a], minlength=len(parts))
        n_links = np.bincount(pair_part, minlength=len(parts))
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, n_groups, n_links, bad], 1)])
        self.links = np.concatenate([self.links, numbers])
        self.held += len(whole)

    def _pair_numbers(self, pairs: np.ndarray) -> np.ndarray:
        distinct, which = np.unique(pairs, return_inverse=True)
        numbers = [self.pair_number.setdefault(p, len(self.pair_number)) for p in distinct.tolist()]
        return np.array(numbers, np.int32)[which.reshape(-1)] if len(pairs) else np.zeros(0, np.int32)

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Per text its counts (a, b, groups, links) and its groups as shown; and all links, text by text, with their pairs.

        Links are numbers of entries of the last array. Without tokens a text has zeros and no links.
        """
        if len(self.number) > REMEMBERED_PARTS or self.held > REMEMBERED_BYTES:
            self.forget()
        split = [(parts_of(" " + t) if self.divisible else [" " + t]) if t else [] for t in texts]
        missing = list(set(chain.from_iterable(split)).difference(self.number))
        if missing:
            self._learn(missing)
        sizes = np.array([len(x) for x in split], np.int64)
        which = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        text_of = np.repeat(np.arange(len(texts)), sizes)
        bad = np.zeros(len(texts), bool)
        bad[text_of[self.counts[which, 4] > 0]] = True
        keep = ~bad[text_of]
        which, text_of = which[keep], text_of[keep]
        counts = np.stack([np.bincount(text_of, self.counts[which, k], len(texts)).astype(np.int64) for k in range(4)], 1)
        shown = ["" if bad[k] else "".join(map(self.shown.__getitem__, map(self.number.__getitem__, x)))[:-1] for k, x in enumerate(split)]
        ends = np.cumsum(self.counts[:, 3])
        n = self.counts[which, 3]
        links = self.links[np.repeat(ends[which] - np.cumsum(n), n) + np.arange(n.sum())]
        return counts, shown, links, np.fromiter(self.pair_number, np.int64, len(self.pair_number))


def align(size_a: np.ndarray, size_b: np.ndarray, part_of_a: np.ndarray) -> tuple[np.ndarray, ...]:
    """Links and groups of two rows of tokens over the same bytes, given the tokens' sizes.

    Returns the two sides of every link, its part, and which tokens of either side are the last of a group.
    """
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    first = np.searchsorted(end_b, end_a - size_a, side="right")
    last = np.searchsorted(end_b, end_a, side="left")
    n = last - first + 1
    link_a = np.repeat(np.arange(len(end_a)), n)
    link_b = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    last_a = end_b[last] == end_a if len(end_a) else np.zeros(0, bool)
    last_b = np.zeros(len(end_b), bool)
    last_b[last[last_a]] = True
    return link_a, link_b, part_of_a[link_a], last_a, last_b


def postings(links: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes], list[bytes | None]]:
    """Numbers of the pairs linked in a block, their document counts, sets and planes.

    ``links`` has the pairs of one document after the other, ``sizes`` their number in each. Equal pairs of
    a document are one member with a multiplicity; the bits of its links beyond the first lie in planes.
    """
    docs = len(sizes)
    member, times = np.unique(links.astype(np.int64) * docs + np.repeat(np.arange(docs), sizes), return_counts=True)
    distinct, counts = np.unique(member // max(docs, 1), return_counts=True)
    place = (member % docs).astype("<u2")
    ends = np.cumsum(counts)
    raw = place.tobytes()
    sets = [raw[2 * (e - n) : 2 * e] for e, n in zip(ends.tolist(), counts.tolist())]
    width = -(-docs // 8)
    for k in np.flatnonzero(2 * counts > width).tolist():
        bits = np.zeros(8 * width, np.uint8)
        bits[place[ends[k] - counts[k] : ends[k]]] = 1
        sets[k] = b"\x01" + np.packbits(bits).tobytes()  # an odd length marks a bitmap
        if len(sets[k]) % 2 == 0:
            sets[k] += b"\x00"
    more = times - 1
    planes: list[bytes | None] = [None] * len(distinct)
    top = np.maximum.reduceat(more, ends - counts) if len(distinct) else more
    for k in np.flatnonzero(top).tolist():
        mine = more[ends[k] - counts[k] : ends[k]]
        planes[k] = b"".join(np.packbits((mine >> j & 1).astype(np.uint8)).tobytes() for j in range(int(top[k]).bit_length()))
    return distinct, counts, sets, planes


def members(data: bytes, count: int, planes: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of a posting and the number of links of each."""
    if len(data) % 2:
        place = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1)))[:count]
    else:
        place = np.frombuffer(data, "<u2")
    times = np.ones(count, np.int64)
    if planes:
        width = -(-count // 8)
        for j in range(len(planes) // width):
            bits = np.unpackbits(np.frombuffer(planes, np.uint8, count=width, offset=j * width), count=count)
            times += bits.astype(np.int64) << j
    return place, times


_FACTS = pa.schema([
    ("block", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
    ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
    ("pair", pa.int64()), ("n_docs", pa.int32()), ("docs", pa.binary()), ("planes", pa.binary()),
])
_FACTS_DDL = (
    "block bigint, place int, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "pair bigint, n_docs int, docs binary, planes binary"
)


def _blocks(path_a: str, path_b: str, block_docs: int, block_chars: int):
    """Rows of two kinds: facts of a document (pair null) and postings of a block (place null)."""

    def rows(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _FACTS], schema=_FACTS
        )

    def run(batches):
        aligner = Aligner.of_worker(path_a, path_b)
        made = 0

        def block(ids: list, texts: list):
            nonlocal made
            key = (TaskContext.get().partitionId() << 32) + made
            made += 1
            counts, groups, links, pairs = aligner.texts(texts)
            shown = [hashlib.sha256(x.encode()).hexdigest() if n else "" for x, n in zip(groups, counts[:, 0].tolist())]
            n_a, n_b, n_groups, n_links = counts.T
            yield rows(
                block=[key] * len(ids), place=range(len(ids)), doc_id=ids, n_a=n_a, n_b=n_b, n_groups=n_groups,
                n_links=n_links, groups_sha256=shown,
            )
            found, n_docs, sets, planes = postings(links, n_links)
            pair = pairs[found]
            for at in range(0, len(pair), 50_000):
                to = at + 50_000
                yield rows(block=[key] * len(pair[at:to]), pair=pair[at:to], n_docs=n_docs[at:to], docs=sets[at:to], planes=planes[at:to])

        ids, texts, total = [], [], 0
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(key)
                texts.append(text.as_py())
                total += len(texts[-1] or "")
                if len(ids) >= block_docs or total >= block_chars:
                    yield from block(ids, texts)
                    ids, texts, total = [], [], 0
        if ids:
            yield from block(ids, texts)

    return run


def _scores(batches):
    """Per block: what its postings, sorted by block, add to each document."""
    schema = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("n_best", pa.int64()), ("count_sum", pa.int64())])
    key, best, total = None, None, None

    def done() -> pa.RecordBatch:
        at = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays(
            [pa.array([key] * len(at), pa.int64()), pa.array(at, pa.int32()), pa.array(best[at]), pa.array(total[at])], schema=schema
        )

    for b in batches:
        if not b.num_rows:
            continue
        blocks, n_docs, count, is_best = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        docs, planes = b.column(4).to_pylist(), b.column(5).to_pylist()
        edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for lo, hi in zip(edges, edges[1:]):
            if blocks[lo] != key:
                if key is not None:
                    yield done()
                key, best, total = int(blocks[lo]), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
            # Lists without planes, by far the most, are added up together.
            plain = [k for k in range(lo, hi) if planes[k] is None and len(docs[k]) % 2 == 0]
            place = np.frombuffer(b"".join([docs[k] for k in plain]), "<u2")
            n = n_docs[plain]
            total += np.bincount(place, np.repeat(count[plain], n), 1 << 16).astype(np.int64)
            best += np.bincount(place, np.repeat(is_best[plain], n), 1 << 16).astype(np.int64)
            for k in sorted(set(range(lo, hi)).difference(plain)):
                place, times = members(docs[k], int(n_docs[k]), planes[k])
                total[place] += times * int(count[k])
                best[place] += times * int(is_best[k])
    if key is not None:
        yield done()


def align_corpus(
    docs: DataFrame, path_a: str = BYTE_LEVEL, path_b: str = PIECES, block_docs: int = BLOCK_DOCS, block_chars: int = BLOCK_CHARS
) -> tuple[DataFrame, DataFrame]:
    """Align the tokens of every text by both tokenizers: results per document and the table of linked pairs.

    The first table has a row for each row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum and groups_sha256. The second has a, b, n_docs (documents that hold the pair linked) and
    is_best. A text that is null or empty, or that a tokenizer does not give back byte for byte, has no
    tokens: zeros and an empty string. Null and repeated ids are rows of their own; other columns are
    ignored; an empty table gives empty results. ``block_docs`` is at most 65,536.
    """
    named = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    rows = checkpointed(named.mapInArrow(_blocks(path_a, path_b, min(block_docs, 1 << 16), block_chars), _FACTS_DDL))
    facts = rows.filter(F.col("place").isNotNull())
    sets = rows.filter(F.col("pair").isNotNull()).select("block", "pair", "n_docs", "docs", "planes")
    counts = sets.groupBy("pair").agg(F.sum("n_docs").alias("count"))
    counts = checkpointed(counts.withColumn("a", F.shiftright("pair", 32)))
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    ranked = checkpointed(counts.join(highest, "a").select("pair", "count", (F.col("count") == F.col("highest")).cast("int").alias("best")))
    worth = sets.join(ranked, "pair").select("block", "n_docs", "count", "best", "docs", "planes")
    worth = worth.repartition("block").sortWithinPartitions("block")
    scores = worth.mapInArrow(_scores, "block bigint, place int, n_best bigint, count_sum bigint")
    out = facts.join(scores, ["block", "place"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")], "groups_sha256"
    )
    pairs = ranked.select(
        F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND((1 << 32) - 1).alias("b"), F.col("count").alias("n_docs"),
        (F.col("best") == 1).alias("is_best"),
    )
    return out, pairs
