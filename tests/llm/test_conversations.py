"""Repair of conversations against plain searches, on awkward turns and on the whole table."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import helpers as H
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from terrapanel.llm import conversations as C
from terrapanel.llm import queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string, part bigint, turns string, _tie int, state string, audit int"
EXTRA = (4, "t", 1, "s", 9)
GOOD = re.compile(r"(s?(ua)+)?")
STEP = {"": "su", "s": "u", "u": "a", "a": "u"}


def plain(turns):
    """(cost, audit, repaired) by uniform-cost search over whole edit strings, least string first."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, kept = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(turns) and last in ("", "a"):
            return cost, audit, kept
        for x in STEP[last]:
            if x != "s":
                heapq.heappush(heap, (cost + 5, audit + "I", i, x, (*kept, ({"u": "user", "a": "assistant"}[x], ""))))
        if i < len(turns):
            role, text, fault = turns[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, kept))
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                if role[:1] and role[:1] in STEP[last]:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, role[:1], (*kept, (role, text))))
                for x in STEP[last]:
                    if x != "s":
                        heapq.heappush(heap, (cost + 1 + extra, audit + "R", i + 1, x, (*kept, ({"u": "user", "a": "assistant"}[x], text))))


def with_faults(turns):
    seen, out = set(), []
    for role, text in turns:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def facts(rows):
    """Facts of a conversation from its (turn, role, text) rows in order."""
    turns = with_faults([r[1:] for r in rows])
    numbers = [r[0] for r in rows if r[0] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    count = lambda f: sum(t[2] == f for t in turns)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    cost, audit, kept = plain(turns)
    return (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit), list(kept)


def in_order(rows):
    def tie(text):
        h = xxhash.xxh64_intdigest(text.encode(), 42)
        return h - (1 << 64) if h >> 63 else h

    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], tie(r[2])))


def digest(kept):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k:
            row = (turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
            out[conv] += [row] * (2 if k == 3 else 1)
    return out


def make_rows(seed=5):
    rnd = random.Random(seed)
    texts = ["Fine.", "Why?", "No stop", "", " \t\n", "Ends! ", "a\nb.", None, "über so ", "...", "x" * 5000 + "."]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "s", "User"]
    rows = []
    for conv in [*range(120), None]:
        for t in range(rnd.randint(1, 9)):
            turn = rnd.choice([t, t, t, t, t + 3, None, -t])
            role = ("user", "assistant")[t % 2] if rnd.random() < 0.6 else rnd.choice(roles)
            rows.append((conv, turn, role, rnd.choice(texts) if rnd.random() < 0.5 else f"Line {conv} {t}.", *EXTRA))
            if rnd.random() < 0.1:
                rows.append(rows[-1])
    rows += [(900, t, ("user", "assistant")[t % 2], f"Turn {t % 70}" + ".!?x"[t % 4], *EXTRA) for t in range(400) if t % 11]
    rows += [(None, None, None, None, *EXTRA)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [(2048, 1 << 22), (7, 1 << 22), (1, 60)])
def test_repair(spark, sizes):
    rows = make_rows()
    whole, parts = C.repair(spark.createDataFrame(rows, SCHEMA).repartition(7), *sizes)
    by_conv = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        by_conv[conv].append((turn, " " if role is None else role, " " if text is None else text))
    expected = {conv: facts(in_order(r)) for conv, r in by_conv.items()}
    got = whole.collect()
    assert len(got) == len(expected)
    in_parts = defaultdict(list)
    for r in sorted(parts.collect(), key=lambda r: r.part):
        in_parts[r.conv_id] += [tuple(t) for t in r.turns]
    digests = {r.conv_id: r.sha256 for r in C.part_digests(parts).collect()}
    for r in got:
        numbers, kept = expected[r.conv_id]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == numbers, r.conv_id
        mine = in_parts[r.conv_id] if r.turns is None else [tuple(t) for t in r.turns]
        assert mine == kept and GOOD.fullmatch("".join(role[:1] for role, _ in mine))
        if r.turns is None:
            assert digests[r.conv_id] == digest(kept)
    assert len(in_parts) >= (2 if sizes[0] > 100 else 20)


def test_nothing_to_repair(spark):
    whole, parts = C.repair(spark.createDataFrame([], SCHEMA))
    assert whole.count() == 0 and parts.count() == 0 and C.part_digests(parts).count() == 0


def test_query_on_the_whole_table(spark, tmp_path):
    path = "/root/testdata/sf0.001/conversations.parquet"
    rows = [tuple(r.values()) for r in pq.read_table(path).to_pylist()]
    rows += [r[:4] for r in make_rows(8)]
    rows = [(c, None if t is None else t + 20 * k, r, x) for k, (c, t, r, x) in enumerate(dict.fromkeys(rows))]  # no ties of turns
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.QUERIES["op13_conversation_repair"](spark, str(tmp_path)).collect()
    left = damage(rows)
    expected = []
    for conv in {r[0] for r in rows}:
        numbers, kept = facts(in_order(left[conv])) if left[conv] else ((0, 0, 0, 0, 0, 0, ""), [])
        expected.append((conv, *numbers, digest(kept)))
    assert H.multiset(tuple(r) for r in got) == H.multiset(expected)


def test_least_cost_and_audit_by_trying_all_edits():
    letters = {"D": 2, "K": 0, "R": 1, "I": 5}

    def tried(turns, most_inserts=2):
        found = []
        for edits in itertools.product("DKR", repeat=len(turns)):
            for k in range(most_inserts + 1):
                for where in itertools.combinations_with_replacement(range(len(turns) + 1), k):
                    audit, slots, cost = "", [], 0
                    for i in range(len(turns) + 1):
                        for _ in range(where.count(i)):
                            audit, cost = audit + "I", cost + 5
                            slots.append("ua")
                        if i < len(turns):
                            role, must_go, extra = turns[i]
                            e = edits[i]
                            audit, cost = audit + e, cost + letters[e] + (extra if e != "D" else 0)
                            if e != "D":
                                slots.append("" if must_go else role if e == "K" else "ua")
                    if any(GOOD.fullmatch("".join(x)) for x in itertools.product(*slots)):
                        found.append((cost, audit))
        return min(found)

    rnd = random.Random(2)
    for _ in range(150):
        turns = [(rnd.choice("suuaaat"), rnd.random() < 0.2, 5 * (rnd.random() < 0.25)) for _ in range(rnd.randint(0, 4))]
        assert C.Lattice(turns).cheapest(0, C.FINAL) == tried(turns), turns
