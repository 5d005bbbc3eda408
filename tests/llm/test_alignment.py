"""Token alignment against whole-text encoding and a plain count of linked pairs."""

import hashlib
from collections import Counter, defaultdict

import helpers as H
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terrapanel.llm import alignment

LETTERS = alignment.byte_level_alphabet()
A = Tokenizer.from_file(alignment.BYTE_LEVEL)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES)


def token_bytes(text):
    a = A.encode(" " + text, add_special_tokens=False).ids
    b = B.encode(text)
    as_bytes = [bytes(LETTERS[c] for c in A.id_to_token(i)) for i in a]
    out = []
    for i in b:
        p = B.id_to_piece(i)
        out.append(bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode())
    return a, as_bytes, b, out


def brute(texts):
    """Facts of each text by comparing the byte ranges of all token pairs."""
    facts, links = [], []
    for t in texts:
        a, la, b, lb = token_bytes(t) if t else ([], [], [], [])
        if not t or b"".join(la) != (" " + t).encode() or b"".join(lb) != (" " + t).encode():
            facts.append((0, 0, 0, ""))
            links.append([])
            continue
        ea, eb = np.cumsum([len(x) for x in la]), np.cumsum([len(x) for x in lb])
        cuts = np.intersect1d(ea, eb)
        group_a, group_b = defaultdict(list), defaultdict(list)
        for i, e in zip(a, ea):
            group_a[np.searchsorted(cuts, e)].append(str(i))
        for i, e in zip(b, eb):
            group_b[np.searchsorted(cuts, e)].append(str(i))
        shown = ";".join(",".join(group_a[k]) + "|" + ",".join(group_b[k]) for k in range(len(cuts)))
        mine = []
        for i, e, x in zip(a, ea, la):
            first = np.searchsorted(eb, e - len(x), side="right")
            for j in range(first, len(b)):
                if eb[j] - len(lb[j]) >= e:
                    break
                mine.append((i, b[j]))
        facts.append((len(a), len(b), len(cuts), hashlib.sha256(shown.encode()).hexdigest()))
        links.append(mine)
    count = Counter(p for m in links for p in set(m))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    rows = [
        (f[0], f[1], f[2], len(m), sum(count[p] == best[p[0]] for p in m), sum(count[p] for p in m), f[3])
        for f, m in zip(facts, links)
    ]
    return rows, {(a, b): (n, n == best[a]) for (a, b), n in count.items()}


ODD = [
    "a", " ", "  ", "a ", " a", "a  b", "a   b  ", "\n\n a\n", "tab\tand \t mix", "<|endoftext|> <s> </s> <unk> <0x41>", "▁ and▁ ▁", "ﬁne Ⅳ ½",
    "é é x ́y", "日本語 の 文 章。", "emoji 👩‍👩‍👧 end", "\x00\x01 \x85 \xa0  x 　", "it's we'll DON'T 12345 3.14", "a\r\nb \r\n c", "﻿bom x",
    "word" * 3000, "x " * 5000, " " * 300 + "z" + " " * 300,
]


@pytest.mark.parametrize("block_docs", [8192, 3])
def test_alignment(awkward, nothing, spark, block_docs):
    rows, _, docs = awkward
    extra = spark.createDataFrame([(5000 + i, t) for i, t in enumerate(ODD)], "doc_id bigint, text string")
    both = docs.select("doc_id", "text").union(extra)
    facts, pairs = alignment.align_corpus(both.withColumns({"block": F.lit("x"), "pair": F.lit(1), "place": F.lit(None)}), block_docs=block_docs)
    expected, counts = brute([r[1] for r in rows] + ODD)
    ids = [r[0] for r in rows] + [5000 + i for i in range(len(ODD))]
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert H.multiset(tuple(r) for r in facts.select("doc_id", *names).collect()) == H.multiset((d, *f) for d, f in zip(ids, expected))
    assert {(r.a, r.b): (r.n_docs, r.is_best) for r in pairs.collect()} == counts
    if block_docs == 3:
        none, pairs = alignment.align_corpus(nothing)
        assert none.count() == 0 and pairs.count() == 0


def test_postings_hold_every_member_and_multiplicity():
    rng = np.random.default_rng(3)
    links = [rng.integers(0, 40, rng.integers(0, 200)).astype(np.int64) ** 2 for _ in range(90)] + [np.array([7, 8, 8, 8])]
    pair, counts, sets, planes = alignment.postings(np.concatenate(links), np.array([len(x) for x in links]))
    got = {}
    for k, p in enumerate(pair.tolist()):
        place, times = alignment.members(sets[k], int(counts[k]), planes[k])
        got |= {(p, d): n for d, n in zip(place.tolist(), times.tolist())}
    assert got == {(p, d): n for d, x in enumerate(links) for p, n in Counter(x.tolist()).items()}
    assert any(len(s) % 2 for s in sets) and any(len(s) % 2 == 0 for s in sets) and any(planes)
