"""Suffixes of a text in order, with common prefixes, by induced sorting in external memory.

A suffix is small where it is less than the next one, else large; a small one after a large one is
a star. Star suffixes are sorted first: induction sorts the pieces from star to star, their ranks
spell a reduced text of at most half the length, and its suffixes are sorted in the same way, by
recursion while they do not fit into the memory allowed. From the sorted stars one pass in
ascending order induces the large suffixes and one in descending order the small ones: each suffix
taken from a priority queue puts the suffix one place to its left into the queue.

The queue holds tuples (place, common prefix) by first character and hands equal characters out in
the order they came. What exceeds the memory allowed goes to an unnamed file that lives as long as
the task. The common prefix of two suffixes induced one after the other into a character is one
more than the least common prefix between their inducers, so it travels along in the tuples.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator

import numpy as np

#: Tuples that a queue holds in memory, and longest reduced text sorted in memory.
ROOM = 2 << 20
#: Tuples handled at a time.
BATCH = 1 << 18
_FAR = np.iinfo(np.int64).max


def on_disk(dtype: str) -> tuple:
    """An unnamed temporary file to append to, and how to map it."""
    file = tempfile.TemporaryFile()

    def mapped() -> np.ndarray:
        file.flush()
        return np.memmap(file, dtype=dtype, mode="r") if file.tell() else np.zeros(0, dtype)

    return file, mapped


class BucketQueue:
    """Priority queue of rows of two integers by character; of equal characters the first pushed comes first."""

    def __init__(self, room: int, descending: bool = False) -> None:
        self.room, self.sign = room, -1 if descending else 1
        self.chunks: dict[int, list] = {}
        self.heap: list[int] = []
        self.held = 0
        self.file = None

    def push(self, chars: np.ndarray, rows: np.ndarray) -> None:
        """``chars`` ascend."""
        edges = [0, *(np.flatnonzero(np.diff(chars)) + 1).tolist(), len(chars)]
        for lo, hi in zip(edges, edges[1:]):
            if hi > lo:
                c = int(chars[lo])
                if c not in self.chunks:
                    self.chunks[c] = []
                    heapq.heappush(self.heap, self.sign * c)
                self.chunks[c].append(rows[lo:hi])
        self.held += len(chars)
        if self.held > self.room:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        for c, chunks in self.chunks.items():
            held = [x for x in chunks if not isinstance(x, tuple)]
            if held:
                rows = np.concatenate(held)
                self.file.write(rows.tobytes())
                self.chunks[c] = [x for x in chunks if isinstance(x, tuple)] + [(at, len(rows))]
                at += rows.nbytes
        self.held = 0

    def first(self) -> int | None:
        return self.sign * self.heap[0] if self.heap else None

    def take(self, char: int) -> Iterator[np.ndarray]:
        """All rows of ``char``, which comes first, in batches; also those pushed meanwhile."""
        while self.first() == char:
            heapq.heappop(self.heap)
            waiting, size = [], 0
            for x in self.chunks.pop(char):
                if isinstance(x, tuple):
                    at, n = x
                    for k in range(0, n, BATCH):
                        if waiting:
                            yield np.concatenate(waiting)
                            waiting, size = [], 0
                        self.file.seek(at + 16 * k)
                        yield np.frombuffer(self.file.read(16 * min(BATCH, n - k)), np.int64).reshape(-1, 2)
                    continue
                self.held -= len(x)
                waiting.append(x)
                size += len(x)
                if size >= BATCH:
                    yield np.concatenate(waiting)
                    waiting, size = [], 0
            if waiting:
                yield np.concatenate(waiting)


class Shelf:
    """Rows by character in the order written, kept on disk, read forwards or backwards."""

    def __init__(self) -> None:
        self.file = tempfile.TemporaryFile()
        self.at: dict[int, list[tuple[int, int]]] = {}

    def put(self, char: int, rows: np.ndarray) -> None:
        self.at.setdefault(char, []).append((self.file.tell(), len(rows)))
        self.file.write(np.ascontiguousarray(rows).tobytes())

    def read(self, char: int, backwards: bool = False) -> Iterator[np.ndarray]:
        runs = self.at.get(char, ())
        for at, n in reversed(runs) if backwards else runs:
            ks = range(0, n, BATCH)
            for k in reversed(ks) if backwards else ks:
                self.file.seek(at + 16 * k)
                yield np.frombuffer(self.file.read(16 * min(BATCH, n - k)), np.int64).reshape(-1, 2)


def _run(text: np.ndarray, place: int, cap: int) -> int:
    """How often the character at ``place`` stands there in a row, ``cap`` at most."""
    piece = text[place : place + cap]
    other = np.flatnonzero(piece != piece[0])
    return int(other[0]) if len(other) else len(piece)


class _Induction:
    """Puts the left neighbours of scanned suffixes into a queue, with common prefixes up to ``cap`` (0: none)."""

    def __init__(self, text: np.ndarray, queue: BucketQueue, cap: int, chars: int) -> None:
        self.text, self.queue, self.cap = text, queue, cap
        # Least common prefix scanned since the last push into each character.
        self.since = np.zeros(chars if cap else 0, np.int64)

    def new_character(self) -> None:
        self.since.fill(0)

    def scan(self, rows: np.ndarray, char: int, equal: bool) -> None:
        """Push the neighbours beyond ``char``, in the queue's direction, and those equal to it where asked."""
        place = rows[:, 0]
        left = np.where(place > 0, self.text[place - 1].astype(np.int64), -1 if self.queue.sign > 0 else _FAR)
        wanted = (left > char if self.queue.sign > 0 else left < char) | ((left == char) & equal)
        at = np.flatnonzero(wanted)
        order = at[np.argsort(left[at], kind="stable")]
        target = left[order]
        out = np.zeros((len(order), 2), np.int64)
        out[:, 0] = place[order] - 1
        if self.cap:
            common = rows[:, 1]
            new = np.ones(len(order), bool)
            new[1:] = target[1:] != target[:-1]
            out[new, 1] = np.minimum(self.since[target[new]], np.minimum.accumulate(common)[order[new]])
            again = np.flatnonzero(~new)
            if len(again):
                spans = np.stack([order[again - 1] + 1, order[again] + 1], 1).reshape(-1)
                out[again, 1] = np.minimum.reduceat(np.append(common, _FAR), spans)[::2]
            out[:, 1] = np.minimum(out[:, 1] + 1, self.cap)
            np.minimum(self.since, common.min(), out=self.since)
            if len(order):
                last = np.append(new[1:], True)
                rest = np.append(np.minimum.accumulate(common[::-1])[::-1], _FAR)
                self.since[target[last]] = rest[order[last] + 1]
        if len(order):
            self.queue.push(target, out)


def _induced(text: np.ndarray, stars, star_chars: list[int], room: int, cap: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes but the last, in descending order, each with its common prefix with the one before."""
    chars = int(text.max()) + 1
    large, queue = Shelf(), BucketQueue(room)
    passing = _Induction(text, queue, cap, chars)
    waiting = iter(star_chars)
    next_star = next(waiting, None)
    while True:
        c = min((x for x in (queue.first(), next_star) if x is not None), default=None)
        if c is None:
            break
        passing.new_character()
        last = None
        for rows in queue.take(c):
            if last is None:
                rows = rows.copy()
                rows[0, 1] = 0
            last = int(rows[-1, 0])
            large.put(c, rows)
            passing.scan(rows, c, equal=True)
        if c == next_star:
            new = True
            for rows in stars.read(c):
                if new:
                    rows = rows.copy()
                    rows[0, 1] = 0 if last is None or not cap else min(_run(text, last, cap), _run(text, int(rows[0, 0]), cap))
                    new = False
                passing.scan(rows, c, equal=False)
            next_star = next(waiting, None)
    queue = BucketQueue(room, descending=True)
    passing = _Induction(text, queue, cap, chars)
    left = sorted(large.at)
    while left or queue.heap:
        c = max(x for x in (queue.first(), left[-1] if left else None) if x is not None)
        passing.new_character()
        last = None
        for rows in queue.take(c):
            if last is None:
                rows = rows.copy()
                rows[0, 1] = 0
            last = int(rows[-1, 0])
            passing.scan(rows, c, equal=True)
            yield rows[:, 0], rows[:, 1]
        if left and left[-1] == c:
            left.pop()
            shared = None
            for rows in large.read(c, backwards=True):
                if shared is None:
                    shared = 0 if last is None or not cap else min(_run(text, last, cap), _run(text, int(rows[-1, 0]), cap))
                down = np.empty_like(rows)
                down[:, 0] = rows[::-1, 0]
                down[0, 1], down[1:, 1] = shared, rows[:0:-1, 1]
                shared = int(rows[0, 1])
                passing.scan(down, c, equal=False)
                yield down[:, 0], down[:, 1]


def star_places(text: np.ndarray) -> Iterator[np.ndarray]:
    """Starts of runs of a character that stand between greater ones, and the last place, ascending."""
    starts, kinds = np.zeros(0, np.int64), np.zeros(0, text.dtype)
    for lo in range(0, len(text), BATCH):
        piece = text[max(lo - 1, 0) : lo + BATCH]
        new = np.flatnonzero(piece[1:] != piece[:-1]) + max(lo, 1)
        if lo == 0:
            new = np.concatenate([[0], new])
        starts, kinds = np.concatenate([starts, new]), np.concatenate([kinds, text[new]])
        yield starts[1:-1][(kinds[:-2] > kinds[1:-1]) & (kinds[1:-1] < kinds[2:])]
        starts, kinds = starts[-2:], kinds[-2:]
    yield np.array([len(text) - 1])


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int, step: int = 16) -> np.ndarray:
    """Common prefix of the suffixes at ``a`` and ``b``, ``cap`` at most; the text ends with its only least character."""
    out = np.zeros(len(a), np.int64)
    active, at = np.arange(len(a)), 0
    end = len(text) - 1
    while at < cap and len(active):
        k = at + np.arange(min(step, cap - at))
        same = text[np.minimum(a[active][:, None] + k, end)] == text[np.minimum(b[active][:, None] + k, end)]
        whole = same.all(1)
        out[active] += np.where(whole, len(k), same.argmin(1))
        active = active[whole]
        at += step
    return out


def _differ(text: np.ndarray, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether the pieces of these sizes at ``a`` and ``b`` differ."""
    out = size_a != size_b
    active, k = np.flatnonzero(~out), 0
    while len(active):
        other = text[a[active] + k] != text[b[active] + k]
        out[active[other]] = True
        k += 1
        active = active[~other & (size_a[active] > k)]
    return out


def ranks_in_memory(text: np.ndarray, enough: int) -> np.ndarray:
    """Places in order of their suffixes by doubling, over the first ``enough`` characters at least."""
    rank = np.unique(text, return_inverse=True)[1].reshape(-1).astype(np.int64)
    k, n = 1, len(text)
    while True:
        if k >= enough or len(rank) == 0 or rank.max() == n - 1:
            return np.argsort(rank, kind="stable")
        behind = np.zeros(n, np.int64)
        if k < n:
            behind[:-k] = rank[k:] + 1
        key = rank * (n + 1) + behind
        order = np.argsort(key, kind="stable")
        ascending = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(ascending[1:] != ascending[:-1])])
        k *= 2


def suffixes(text: np.ndarray, cap: int, room: int = ROOM, with_common: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all suffixes but the last in descending order, in batches, with common prefixes.

    ``text`` ends with its only least character, and may be a mapped file. The order is that of the first
    ``cap`` characters; each common prefix, ``cap`` at most, is that with the suffix before it in the output.
    """
    if len(text) < 2:
        return
    file, mapped = on_disk("<i8")
    for places in star_places(text):
        file.write(places.astype("<i8").tobytes())
    star = mapped()
    order = _star_order(text, star, cap, room)
    shelf = Shelf()
    before = None
    chars: list[int] = []
    for lo in range(0, len(order), BATCH):
        rows = np.zeros((len(order[lo : lo + BATCH]), 2), np.int64)
        rows[:, 0] = star[order[lo : lo + BATCH]]
        if with_common:
            previous = np.concatenate([[rows[0, 0] if before is None else before], rows[:-1, 0]])
            rows[:, 1] = _common(text, previous, rows[:, 0], cap)
            before = rows[-1, 0]
        _shelve(text, shelf, rows, chars)
    yield from _induced(text, shelf, chars, room, cap if with_common else 0)


def _shelve(text: np.ndarray, shelf: Shelf, rows: np.ndarray, chars: list[int]) -> None:
    first = text[rows[:, 0]]
    edges = [0, *(np.flatnonzero(np.diff(first)) + 1).tolist(), len(rows)]
    for lo, hi in zip(edges, edges[1:]):
        c = int(first[lo])
        shelf.put(c, rows[lo:hi])
        if not chars or chars[-1] != c:
            chars.append(c)


def _star_order(text: np.ndarray, star: np.ndarray, cap: int, room: int) -> np.ndarray:
    """Numbers of the star suffixes in ascending order."""
    m = len(star)
    if m == 1:
        return np.zeros(1, np.int64)
    # Any order within a character will do to sort the pieces from star to star.
    shelf = Shelf()
    by_char = BucketQueue(room)
    for lo in range(0, m, BATCH):
        places = np.asarray(star[lo : lo + BATCH])
        order = np.argsort(text[places], kind="stable")
        by_char.push(text[places][order].astype(np.int64), np.stack([places[order], places[order]], 1))
    chars = []
    while by_char.heap:
        c = by_char.first()
        chars.append(c)
        for rows in by_char.take(c):
            shelf.put(c, rows)
    # The last place is a star of its own, less than all others.
    names = np.memmap(tempfile.TemporaryFile(), dtype="<i8", mode="w+", shape=(m,))
    name, before = 0, None
    for places, _ in _induced(text, shelf, chars, room, 0):
        number = np.searchsorted(star, places)
        number = number[star[np.minimum(number, m - 1)] == places]
        if not len(number):
            continue
        ahead = np.concatenate([[number[0] if before is None else before], number[:-1]])
        size = lambda k: star[np.minimum(k + 1, m - 1)] - star[k] + 1
        name_of = name + np.cumsum(_differ(text, star[ahead], star[number], size(ahead), size(number)))
        names[number] = name_of
        name, before = int(name_of[-1]), int(number[-1])
    # Names descend from 0 for the greatest piece; the reduced text needs ascending ones and 0 for its end.
    for lo in range(0, m, BATCH):
        names[lo : lo + BATCH] = name + 1 - names[lo : lo + BATCH]
    names[m - 1] = 0
    if name + 2 == m:
        order = np.empty(m, np.int64)
        order[names] = np.arange(m)
        return order
    # Stars are two places apart at least, so this many pieces hold all characters that count.
    enough = cap // 2 + 1
    if m <= room:
        return ranks_in_memory(names, enough)
    file, mapped = on_disk("<i8")
    for places, _ in suffixes(names, enough, room, with_common=False):
        file.write(places.astype("<i8").tobytes())
    return np.concatenate([[m - 1], mapped()[::-1]])
