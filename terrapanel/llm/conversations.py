"""Repair of conversations at least cost.

The turns of a conversation and the states of its grammar, an optional system turn and then pairs
of a user and an assistant turn, span a lattice whose edges are edits: keep, rerole, delete and
insert. Dijkstra's search runs from both ends of the lattice until no path through an unsettled
node can be as cheap as the best crossing, so that every cheapest path crosses from a settled
forward to a settled reverse node. Of these paths the one whose edits' initials come first is read
off along tight edges.

Turns are dealt to tasks by ranges of (conversation, turn), so one conversation may span many
tasks. A conversation inside one task is repaired there. Pieces of others are searched between
every pair of states, and the pieces' results, which compose, are put together afterwards: two
cheapest edit strings over the same turns are never one the beginning of the other, so the least
string of a concatenation is made of least strings.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.session import checkpointed

#: What edits cost, and what a truncated turn that stays adds.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: White space, and what ends a complete text.
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: States: nothing kept yet, after the system turn, after a user turn, after an assistant turn.
STATES = range(4)
_STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
_FROM = {to: [(q, x) for (q, x), t in _STEP.items() if t == to] for to in STATES}
_NAMES = {"u": "user", "a": "assistant"}
_LEGAL = {"su", "ua", "au"}
#: States in which a conversation may end.
FINAL = (0, 3)
#: Turns and characters of a piece of a conversation, whichever is reached first.
PIECE_TURNS = 2048
PIECE_CHARS = 4 << 20


@dataclass
class Lattice:
    """Edits over a list of turns, each (initial of its role, must go, extra cost if it stays)."""

    turns: list[tuple[str, bool, int]]

    def out(self, node: tuple[int, int]):
        """(letter, next node, cost) of every edit that can follow."""
        i, q = node
        for x in "ua":
            if (q, x) in _STEP:
                yield "I", (i, _STEP[q, x]), INSERT
        if i < len(self.turns):
            initial, must_go, extra = self.turns[i]
            yield "D", (i + 1, q), DELETE
            if not must_go:
                if (q, initial) in _STEP:
                    yield "K", (i + 1, _STEP[q, initial]), extra
                for x in "ua":
                    if (q, x) in _STEP:
                        yield "R", (i + 1, _STEP[q, x]), REROLE + extra

    def into(self, node: tuple[int, int]):
        """(node before, cost) of every edit that can lead here."""
        i, q = node
        for p, x in _FROM[q]:
            if x != "s":
                yield (i, p), INSERT
        if i:
            initial, must_go, extra = self.turns[i - 1]
            yield (i - 1, q), DELETE
            if not must_go:
                for p, x in _FROM[q]:
                    if x == initial:
                        yield (i - 1, p), extra
                    if x != "s":
                        yield (i - 1, p), REROLE + extra

    def cheapest(self, start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
        """Least cost from a state to one of ``ends``, and the ASCII-least initials of such edits."""
        origin, goals = (0, start), {(len(self.turns), q) for q in ends}
        dist = ({origin: 0}, dict.fromkeys(goals, 0))
        heaps = ([(0, origin)], [(0, g) for g in sorted(goals)])
        settled: tuple[dict, dict] = ({}, {})
        best = 0 if origin in goals else None

        def top(side: int) -> float:
            while heaps[side] and heaps[side][0][1] in settled[side]:
                heapq.heappop(heaps[side])
            return heaps[side][0][0] if heaps[side] else float("inf")

        while True:
            tops = top(0), top(1)
            # Equal sums go on: an equally cheap crossing may still be ahead.
            if min(tops) == float("inf") or best is not None and sum(tops) > best:
                break
            side = 0 if tops[0] <= tops[1] else 1
            d, node = heapq.heappop(heaps[side])
            settled[side][node] = d
            near = self.into(node) if side else ((w, c) for _, w, c in self.out(node))
            for w, c in near:
                if d + c < dist[side].get(w, float("inf")):
                    dist[side][w] = d + c
                    heapq.heappush(heaps[side], (d + c, w))
                if w in dist[1 - side]:
                    through = d + c + dist[1 - side][w]
                    best = through if best is None else min(best, through)
        if best is None:
            return None
        return best, self._least(origin, goals, *settled, top(0), best)

    def _least(self, origin, goals, ahead: dict, back: dict, bound: float, best: int) -> str:
        """Initials along the least of the cheapest paths; each crosses once from below to beyond ``bound``."""
        ahead = {v: d for v, d in ahead.items() if d < bound}
        tails = [v for v, d in ahead.items() if v in goals and d == best]
        for v, d in ahead.items():
            if any(w not in ahead and w in back and d + c + back[w] == best for _, w, c in self.out(v)):
                tails.append(v)
        good, todo = set(tails), tails
        while todo:
            v = todo.pop()
            for w, c in self.into(v):
                if w not in good and w in ahead and ahead[w] + c == ahead[v]:
                    good.add(w)
                    todo.append(w)
        letters = []
        front = {origin}
        while not any(v in goals and (ahead[v] == best if v in ahead else back[v] == 0) for v in front):
            steps: dict[str, set] = {}
            for v in front:
                for letter, w, c in self.out(v):
                    if v in good:
                        tight = w in good and ahead[v] + c == ahead[w] or w not in ahead and w in back and ahead[v] + c + back[w] == best
                    else:
                        tight = w not in ahead and w in back and back[v] == c + back[w]
                    if tight:
                        steps.setdefault(letter, set()).add(w)
            letter = min(steps)
            letters.append(letter)
            front = steps[letter]
        return "".join(letters)


def apply_edits(turns: list[tuple[str, str]], audit: str, state: int = 0) -> list[tuple[str, str]]:
    """The (role, text) turns that the edits leave; roles they set follow from the state."""
    out, i = [], 0
    for letter in audit:
        set_to = "a" if state == 2 else "u"
        if letter == "I":
            out.append((_NAMES[set_to], ""))
        else:
            role, text = turns[i]
            i += 1
            if letter == "D":
                continue
            if letter == "K":
                set_to = role[:1]
                out.append((role, text))
            else:
                out.append((_NAMES[set_to], text))
        state = _STEP[state, set_to]
    return out


def complete(text: str) -> bool:
    return text.rstrip(BLANKS)[-1:] in tuple(ENDS)


@dataclass
class Piece:
    """Consecutive turns of one conversation, with the counts that add up over pieces."""

    conv: int | None
    turns: list[tuple[str, str]] = field(default_factory=list)
    lattice: list[tuple[str, bool, int]] = field(default_factory=list)
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    places: int = 0  # distinct turn numbers
    least: int | None = None
    most: int | None = None
    chars: int = 0

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        is_blank = not text.strip(BLANKS)
        cut = not is_blank and not seen and not complete(text)
        self.blank += is_blank
        self.duplicate += not is_blank and seen
        self.truncated += cut
        if self.turns:
            self.illegal += self.turns[-1][0][:1] + role[:1] not in _LEGAL
        if turn is not None and turn != self.most:
            self.places += 1
            self.least = turn if self.least is None else self.least
            self.most = turn
        self.turns.append((role, text))
        self.lattice.append((role[:1], is_blank or seen, TRUNCATED * cut))
        self.chars += len(text)

    @property
    def gaps(self) -> int:
        return 0 if self.least is None else self.most - self.least + 1 - self.places


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_TURNS_DDL = "array<struct<role: string, text: string>>"
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_SOLVED = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("audit", pa.string()), ("turns", _TURNS),
    ("places", pa.int64()), ("least", pa.int64()), ("most", pa.int64()), ("edges", pa.string()), ("between", pa.string()),
])
_SOLVED_DDL = (
    f"conv_id bigint, part bigint, {', '.join(c + ' bigint' for c in _COUNTS)}, audit string, turns {_TURNS_DDL}, "
    "places bigint, least bigint, most bigint, edges string, between string"
)


def _as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = []
    for values, f in zip(zip(*rows), schema):
        if f.type == _TURNS:
            values = [None if v is None else [{"role": r, "text": t} for r, t in v] for v in values]
        columns.append(pa.array(values, f.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _whole(p: Piece) -> tuple:
    cost, audit = Lattice(p.lattice).cheapest(0, FINAL)
    return (p.conv, None, p.gaps, p.blank, p.duplicate, p.truncated, p.illegal, cost, audit, apply_edits(p.turns, audit), *[None] * 5)


def _open(p: Piece, part: int) -> tuple:
    """A piece whose conversation may go on elsewhere: its cheapest edits between all states."""
    lattice = Lattice(p.lattice)
    between = {f"{a}{b}": found for a in STATES for b in STATES if (found := lattice.cheapest(a, (b,))) is not None}
    edges = json.dumps([p.turns[0][0][:1], p.turns[-1][0][:1]])
    counts = (None, p.blank, p.duplicate, p.truncated, p.illegal, None)
    return (p.conv, part, *counts, None, p.turns, p.places, p.least, p.most, edges, json.dumps(between))


def _solve(piece_turns: int, piece_chars: int):
    """Per task over sorted turns: conversations inside it repaired, the others' pieces searched."""

    def run(batches):
        first, made, rows, held = True, 0, [], 0
        piece, before = None, None

        def numbered(p: Piece) -> tuple:
            nonlocal made
            made += 1
            return _open(p, (TaskContext.get().partitionId() << 32) + made)

        split = False
        for b in batches:
            for conv, turn, role, text, first_turn, repeated in zip(*(c.to_pylist() for c in b.columns)):
                if piece is None or conv != piece.conv:
                    if piece is not None:
                        rows.append(numbered(piece) if first or split else _whole(piece))
                        held += piece.chars
                        first, split = False, False
                    piece, before = Piece(conv), None
                elif len(piece.turns) >= piece_turns or piece.chars >= piece_chars:
                    rows.append(numbered(piece))
                    held += piece.chars
                    piece, split = Piece(conv), True
                # Equal turns stand side by side and only the first of them is new.
                seen = (turn, role, text) == before or repeated and turn != first_turn
                piece.add(turn, role, text, bool(seen))
                before = (turn, role, text)
                if held > 4 << 20 or len(rows) >= 4096:
                    yield _as_batch(rows, _SOLVED)
                    rows, held = [], 0
        if piece is not None:
            rows.append(numbered(piece))
        if rows:
            yield _as_batch(rows, _SOLVED)

    return run


_CHOICE = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int64()), ("state", pa.int32()), *[(c, pa.int64()) for c in _COUNTS], ("audit", pa.string()),
])
_CHOICE_DDL = f"conv_id bigint, part bigint, state int, {', '.join(c + ' bigint' for c in _COUNTS)}, audit string"


def _compose(batches):
    """Pieces in order: one row of facts a conversation, and for each piece its state and edits."""
    rows: list[tuple] = []
    paths, counts, conv, least, most, last, started = {}, [0] * 4, None, None, None, "", False
    places = 0

    def finish() -> None:
        cost, audit, chain = min(paths[q] for q in FINAL if q in paths)
        gaps = 0 if least is None else most - least + 1 - places
        rows.append((conv, None, None, gaps, *counts, cost, audit))
        while chain is not None:
            part, state, edits, chain = chain
            rows.append((conv, part, state, *[None] * len(_COUNTS), edits))

    for b in batches:
        for key, part, blank, duplicate, truncated, illegal, n, lo, hi, edges, between in zip(*(c.to_pylist() for c in b.columns)):
            if not started or key != conv:
                if started:
                    finish()
                paths, counts, conv, least, most, last, places, started = {0: (0, "", None)}, [0] * 4, key, None, None, None, 0, True
            head, tail = json.loads(edges)
            for k, v in enumerate((blank, duplicate, truncated, illegal)):
                counts[k] += v
            counts[3] += last is not None and last + head not in _LEGAL
            last = tail
            places += n - (lo is not None and lo == most)
            least, most = lo if least is None else least, most if hi is None else hi
            ways: dict = {}
            for step, (cost, edits) in json.loads(between).items():
                a, z = int(step[0]), int(step[1])
                if a in paths:
                    way = (paths[a][0] + cost, paths[a][1] + edits, (part, a, edits, paths[a][2]))
                    if z not in ways or way[:2] < ways[z][:2]:
                        ways[z] = way
            paths = ways
            if len(rows) >= 4096:
                yield _as_batch(rows, _CHOICE)
                rows.clear()
    if started:
        finish()
        yield _as_batch(rows, _CHOICE)


_PARTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("turns", _TURNS)])


def _edit(batches):
    for b in batches:
        if b.num_rows:
            rows = [
                (conv, part, apply_edits([(t["role"], t["text"]) for t in turns], audit, state))
                for conv, part, state, audit, turns in zip(*(c.to_pylist() for c in b.columns))
            ]
            yield _as_batch(rows, _PARTS)


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns with faults set by the checksum of conversation and turn; null roles and texts become one blank."""
    blank = F.lit(" ")
    kind = F.crc32(F.concat(*[F.coalesce(c, blank) for c in (F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))])) % 20
    text = F.coalesce(F.col("text"), blank)
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return (
        conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text", kind.alias("_kind"))
        .filter("_kind != 0")
        .select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"), text.alias("text"), "_kind")
        .withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select("conv_id", "turn", "role", "text")
    )


def repair(
    conversations: DataFrame, piece_turns: int = PIECE_TURNS, piece_chars: int = PIECE_CHARS
) -> tuple[DataFrame, DataFrame]:
    """Repair every conversation of a table of conv_id, turn, role and text; other columns are ignored.

    Returns two tables. The first has a row a conversation: conv_id, gaps (missing turn numbers), blank,
    duplicate, truncated and illegal (neighbours whose roles may not follow each other), cost, audit (the
    edits' initials) and turns, the repaired (role, text) turns, null for a conversation that was dealt to
    several tasks or pieces. The second holds these as conv_id, part (ascending) and turns.

    Turns are taken by number, null numbers first; turns of one number by role, then by the hash of their
    text; of equal turns the later ones are duplicates. Null roles and texts count as one blank. Rows of
    null conv_id are one conversation. An empty table gives empty tables.
    """
    t = conversations.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    ).withColumns({"_tie": F.xxhash64("text"), "_second": F.xxhash64(F.lit(1), "text")})
    rank = F.struct(F.col("turn").isNotNull(), "turn")
    same = ["conv_id", "role", "_tie", "_second"]
    repeats = t.groupBy(*same).agg(F.min(rank).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    repeats = repeats.select(*[F.col(c).alias(f"r_{c}") for c in same], F.col("_first.turn").alias("first_turn"), F.lit(True).alias("repeated"))
    on: Column = F.col("conv_id").eqNullSafe(F.col("r_conv_id"))
    for c in same[1:]:
        on &= F.col(c) == F.col(f"r_{c}")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "_tie", "_second"]
    dealt = t.join(repeats, on, "left").repartitionByRange(*order).sortWithinPartitions(*order, "text")
    solved = checkpointed(
        dealt.select("conv_id", "turn", "role", "text", "first_turn", "repeated").mapInArrow(_solve(piece_turns, piece_chars), _SOLVED_DDL)
    )
    facts = ["conv_id", *_COUNTS, "audit"]
    whole = solved.filter(F.col("part").isNull()).select(*facts, "turns")
    pieces = solved.filter(F.col("part").isNotNull())
    narrow = pieces.select("conv_id", "part", "blank", "duplicate", "truncated", "illegal", "places", "least", "most", "edges", "between")
    chosen = checkpointed(narrow.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_compose, _CHOICE_DDL))
    rest = chosen.filter(F.col("part").isNull()).select(*facts, F.lit(None).cast(_TURNS_DDL).alias("turns"))
    edits = chosen.filter(F.col("part").isNotNull()).select("part", "state", F.col("audit").alias("edits"))
    parts = pieces.select("conv_id", "part", "turns").join(edits, "part").select("conv_id", "part", "state", "edits", "turns")
    return whole.unionByName(rest), parts.mapInArrow(_edit, f"conv_id bigint, part bigint, turns {_TURNS_DDL}")


def joined(turns: Column) -> Column:
    """Turns as lines of role:text."""
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")


def part_digests(parts: DataFrame) -> DataFrame:
    """conv_id and SHA-256 of the lines of all its parts, taken in order and never held together."""
    schema = pa.schema([("conv_id", pa.int64()), ("sha256", pa.string())])

    def run(batches):
        conv, digest, any_line = None, None, False
        rows: list[tuple] = []
        for b in batches:
            for key, n, text in zip(*(c.to_pylist() for c in b.columns)):
                if digest is None or key != conv:
                    if digest is not None:
                        rows.append((conv, digest.hexdigest()))
                    conv, digest, any_line = key, hashlib.sha256(), False
                if n:
                    digest.update(("\n" + text if any_line else text).encode())
                    any_line = True
            if len(rows) >= 4096:
                yield _as_batch(rows, schema)
                rows = []
        if digest is not None:
            rows.append((conv, digest.hexdigest()))
        if rows:
            yield _as_batch(rows, schema)

    dealt = parts.select("conv_id", "part", F.size("turns").alias("n"), joined(F.col("turns")).alias("text"))
    dealt = dealt.repartition("conv_id").sortWithinPartitions("conv_id", "part").select("conv_id", "n", "text")
    return dealt.mapInArrow(run, "conv_id bigint, sha256 string")
