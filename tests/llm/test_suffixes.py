"""Suffix order and removal of repeated bytes against plain versions."""

import random
from collections import Counter

import helpers as H
import numpy as np
import pytest

from terrapanel.llm import induced, suffixes


def check_order(text, cap, room):
    places, common = [], []
    for p, c in induced.suffixes(text, cap, room):
        places += p.tolist()
        common += c.tolist()
    s = text.tolist()
    assert sorted(places) == list(range(max(len(s) - 1, 0)))
    heads = [tuple(s[p : p + cap]) for p in places]
    assert heads == sorted(heads, reverse=True)
    for k, (a, b) in enumerate(zip(heads, heads[1:])):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert common[k + 1] == n


@pytest.mark.parametrize("batch", [5, 1 << 18])
def test_suffixes_are_sorted_with_common_prefixes(monkeypatch, batch):
    """Small rooms make queues spill and the reduced text recurse."""
    monkeypatch.setattr(induced, "BATCH", batch)
    rnd = random.Random(batch)
    for _ in range(150):
        s = [rnd.randint(1, rnd.choice([1, 2, 3, 5, 200])) for _ in range(rnd.randint(0, 120))]
        if rnd.random() < 0.5 and s:
            again = s[: rnd.randint(1, len(s))]
            s = s + again + s[:3] + again
        check_order(np.array(s + [0], np.uint16), rnd.choice([5, 40, 1000]), rnd.choice([3, 10, 10_000]))


def brute(texts, window):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - window + 1):
            if count[d[i : i + window]] > 1:
                gone[i : i + window] = True
        spans = sum(bool(g and (i == 0 or not gone[i - 1])) for i, g in enumerate(gone))
        out.append((len(d), int(gone.sum()), spans, np.frombuffer(d, np.uint8)[~gone].tobytes()))
    return out


@pytest.mark.parametrize("window, shard_bytes, room, piece", [(400, 1 << 26, 1 << 21, 1 << 21), (40, 300, 50, 1000), (13, 1, 1000, 64)])
def test_removal(awkward, spark, window, shard_bytes, room, piece):
    """Small shards split every anchor, small rooms use the disk, small pieces cut texts."""
    rows = [r for r in awkward[0] if r[1] is None or len(r[1]) < 20_000]
    rnd = random.Random(4)
    passage = "".join(rnd.choice("abcdef é") for _ in range(window + 20))
    around = lambda n: "".join(rnd.choice("uvwxyz \n") for _ in range(n))
    for k in (0, 1, 2, 15):  # windows in a shared passage of unlike neighbours
        cut = passage.encode()[: window + k].decode(errors="ignore")
        rows += [(2000 + 10 * k + j, around(rnd.randint(0, 900)) + cut + around(rnd.randint(0, 900)), *r) for j, r in enumerate([rows[0][2:]] * 3)]
    rows.append((2990, passage + around(30) + passage, *rows[0][2:]))
    rows += [(3000 + j, "ab" * 500 + around(50), *rows[0][2:]) for j in range(2)]
    docs = spark.createDataFrame(rows, H.SCHEMA).repartition(4)
    got = suffixes.remove_repeats(docs, window, shard_bytes, room, piece)
    expected = brute([r[1] for r in rows], window)
    found = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()]
    assert H.multiset(found) == H.multiset((r[0], *e) for r, e in zip(rows, expected))
    assert any(e[2] > 1 for e in expected)


def test_long_repetitive_and_missing_texts(spark, nothing):
    texts = ["a" * 30_000, "ab" * 20_000, "z" * 399, "z" * 400, "y" * 400, "y" * 400, None, "", "q" * 401]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id bigint, text string")
    got = [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(docs).collect()]
    assert H.multiset(got) == H.multiset(brute(texts, 400))
    assert suffixes.remove_repeats(nothing).count() == 0
