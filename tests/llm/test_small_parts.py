import time
"""Single parts: segments, plans, codes, trees, blocks of pages."""

import random

import helpers as H
import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapanel.llm import html, mtree, packing, toxicity
from terrapanel.llm.components import components
from terrapanel.llm.token_store import decode_ranks, encode_ranks
from terrapanel.llm.tokens import DEFAULT_TOKENIZER, PartEncoder
from terrapanel.llm.words import from_planes, planes, segments


def all_maximal(scores):
    """The best run, then the same on either side of it, as the definition has it."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            value = sum(scores[i:j])
            if value > 0 and (best is None or (value, -(j - i)) > (best[0], -(best[2] - best[1]))):
                best = (value, i, j)
    if best is None:
        return []
    value, i, j = best
    left, right = all_maximal(scores[:i]), all_maximal(scores[j:])
    return left + [(i, j, value)] + [(a + j, b + j, v) for a, b, v in right]


def test_segments_are_the_maximal_ones():
    rnd = random.Random(3)
    for _ in range(400):
        n = rnd.randint(0, 30)
        # powers of two in disjoint ranges, so that no two runs tie
        gains = [rnd.choice([0, 0, 0, rnd.randint(1, 40)]) + (rnd.random() / 64) for _ in range(n)]
        at = np.array([i for i in range(n) if gains[i] >= 1], dtype=int)
        scores = [gains[i] if gains[i] >= 1 else -8.0 for i in range(n)]
        got = toxicity.segments(at, np.array([gains[i] for i in at]), 8.0)
        expected = all_maximal(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in expected]
        assert np.allclose([v for *_, v in got], [v for *_, v in expected])


def test_decay_solves_the_equation():
    scores, chance = np.array([5.0, 2.0]), np.array([1e-4, 1e-3])
    x = toxicity.decay(scores, chance)
    assert abs((1 - chance.sum()) * np.exp(-x * toxicity.DRIFT) + (chance * np.exp(x * scores)).sum() - 1) < 1e-6


def naive_best_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(capacity - n)
    return len(room)


def test_plan_is_best_fit_and_gapless():
    rnd = random.Random(5)
    for _ in range(60):
        capacity = rnd.choice([7, 30, 64])
        lengths = [rnd.randint(1, capacity) for _ in range(rnd.randint(0, 150))] + [rnd.randint(1, capacity)] * rnd.randint(0, 80)
        counts = {n: lengths.count(n) for n in set(lengths)}
        plan = packing.plan_best_fit(counts, capacity)
        assert plan.sequences == naive_best_fit(lengths, capacity)
        length = np.repeat(list(counts), list(counts.values())).astype(int) if counts else np.zeros(0, int)
        rank = np.concatenate([np.arange(n) for n in counts.values()]) if counts else np.zeros(0, int)
        sequence, offset = plan.places(length, rank)
        used = {}
        for s, o, n in sorted(zip(sequence.tolist(), offset.tolist(), length.tolist())):
            assert used.get(s, 0) == o
            used[s] = o + n
        assert all(n <= capacity for n in used.values()) and len(used) == plan.sequences


def test_plan_size_does_not_follow_the_counts():
    few = packing.plan_best_fit({n: 3 for n in range(1, 200)}, 512)
    many = packing.plan_best_fit({n: 3_000_000 for n in range(1, 200)}, 512)
    assert len(many.n) < 20 * len(few.n) and many.n.sum() == 1_000_000 * few.n.sum()
    with pytest.raises(ValueError):
        packing.plan_best_fit({9: 1}, 8)


def test_codes_round_trip():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = rnd.integers(0, 2 ** rnd.integers(1, 32, n), n).astype(np.uint32)
        control, data = encode_ranks(ranks)
        assert len(control) == -(-n // 4) and (decode_ranks(control, data, n) == ranks).all()
    values = rnd.integers(-(2**60), 2**60, 99)
    assert (from_planes(planes(values), "<i8") == values).all()


def test_encoder_equals_the_library():
    encoder = PartEncoder(DEFAULT_TOKENIZER)
    rnd = random.Random(2)
    some = "aB'.,…sé ß\n\t<|endoftext|> 's don't .. ., a.b ÷ × 1. ½ ΑΣ Ångström ﬁ \xa0 \x85 \x1c 日本 É, ÿ. <|ENDOFTEXT|> ll 'x"
    texts = ["".join(rnd.choice(some) for _ in range(rnd.randint(0, 30))) for _ in range(800)]
    texts += [" ".join(rnd.choice(some.split(" ")) for _ in range(rnd.randint(0, 20))) for _ in range(800)] + ["word " * 5000, "q" * 9000]
    expected = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # the second time from memory
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == expected
    assert encoder.encode([None, ""]) == [b"", b""]


def test_segments_of_text_cut_at_blanks():
    text = b"ab cd\tef  gh" * 50
    parts = list(segments(text, 17))
    assert b"".join(parts) == text and [w for p in parts for w in p.split()] == text.split()


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(200, 260)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (7, 3), (3, 7)]
    edges += [(rnd.randrange(2000, 2100), rnd.randrange(2000, 2100)) for _ in range(60)]
    part = {}

    def top(x):
        part.setdefault(x, x)
        while part[x] != x:
            x = part[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        part[max(a, b)] = min(a, b)
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    expected = {x: top(x) for x in part if x not in alone}
    got = components(spark.createDataFrame(edges, "high bigint, low bigint")).collect()
    assert {r.node: r.component for r in got} == expected and len(got) == len(expected)
    assert components(spark.createDataFrame([], "high bigint, low bigint")).count() == 0


def test_top_k_is_exact(spark):
    rnd = np.random.default_rng(6)
    centres = rnd.normal(size=(9, 16))
    x = centres[rnd.integers(0, 9, 700)] + rnd.normal(size=(700, 16)) * 0.1
    x[100:260] = x[100]  # many equal vectors
    x[300] *= 50
    rows = [(i, [float(e) for e in v], "l") for i, v in enumerate(x)]
    rows += [(701, None, "l"), (702, [float("nan")] * 16, "l"), (703, [float("inf")] * 16, "l"), (704, [None] * 16, "l"), (None, rows[0][1], "l")]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, id string")
    vectors = mtree.quantised(table, "vec_id", "embedding")
    queries = vectors.filter(F.col("id") % 50 == 0)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in mtree.top_k(vectors, queries, 10, tree_rows=150, block_queries=5).collect()}
    q = np.floor(x * 1024).astype(np.int64)
    expected = {}
    for i in range(0, 700, 50):
        scores = q @ q[i]
        order = sorted((j for j in range(700) if j != i), key=lambda j: (-scores[j], j))[:10]
        expected |= {(i, k + 1): (j, int(scores[j])) for k, j in enumerate(order)}
    assert got == expected
    few = vectors.filter("id < 4")
    assert mtree.top_k(few, few.filter("id = 0")).count() == 3
    assert mtree.top_k(few.limit(0), few.limit(0)).count() == 0


def test_top_k_of_vectors_of_several_lengths_and_sizes(spark):
    """Each length is searched alone; components beyond exact floating point still give exact products."""
    rnd = np.random.default_rng(9)
    rows = [(i, rnd.integers(-50, 50, 4 if i % 3 else 7).tolist()) for i in range(120)]
    rows += [(200 + i, (rnd.integers(-(1 << 29), 1 << 29, 4)).tolist()) for i in range(30)] + [(300, [])]
    vectors = spark.createDataFrame(rows, "id bigint, v array<bigint>")
    asked = vectors.filter("id % 20 = 0")
    got = {}
    for r in mtree.top_k(vectors, asked, 5, tree_rows=40, block_queries=3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    expected = {}
    for i, q in rows:
        if i % 20 == 0 and q:
            scores = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in rows if j != i and len(x) == len(q))[:5]
            expected[i] = [(n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    assert {q: sorted(r) for q, r in got.items()} == expected


def test_search_skips_distances():
    rnd = np.random.default_rng(8)
    centres = rnd.normal(size=(60, 8)) * 4000
    x = np.floor(centres[rnd.integers(0, 60, 6000)] + rnd.normal(size=(6000, 8)) * 20).astype(np.int64)
    pages: list = []
    pivot = np.floor(x.mean(axis=0)).astype(np.int64)
    mtree.build(np.arange(6000), x, pivot, pages)
    assert all(len(p["parents"]) <= mtree.LEAF for p in pages if "ids" in p)

    class Counted(list):
        read = 0

        def __getitem__(self, i):
            Counted.read += 1
            return super().__getitem__(i)

    best = mtree.search(Counted(pages), pivot, -1, x[17], 10)
    scores = x @ x[17]
    assert sorted(best, reverse=True) == sorted(((int(s), -i) for i, s in enumerate(scores)), reverse=True)[:10]
    assert Counted.read < len(pages) / 2


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><h1>Site name of the page</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad-box">Buy the best of all things now.</div>
%s<aside>See also the other pages of the site.</aside><footer>&copy; 2020 the owner of the site</footer></body></html>"""


@pytest.mark.parametrize(
    "inner, expected",
    [
        ("<article><header><h1>The title</h1></header><p>First &amp; <b>bold</b>\n\n text.<br>more<p>Second&nbsp;one</article>", "The title\nFirst & bold text. more\nSecond one"),
        ("<main><p>Short.</p><form><p>Your name</p></form><!-- <p>hidden</p> --><p>&lt;b&gt; &eacute;&#233;&#xe9;</p></main>", "Short.\n<b> ééé"),
        ("<article><p>Body of it.</p><div id='comments'><p>A reader says that this is the best.</p></div></article>", "Body of it."),
        ("<article><p>Body of it.</p><ul class=x><li><a href=1>one link</a> <a href=2>two link</a></li></ul></article>", "Body of it."),
        ("<div><p>" + "The river of the town is in the valley and it was there that they had been for all of the day. " * 4 + "</p><p>So it was.</p></div>",
         ("The river of the town is in the valley and it was there that they had been for all of the day. " * 4).strip() + "\nSo it was."),
        ("<div class='cookie-notice'><p>We use the cookies of this site to be of help to you and to all of the others.</p></div>", ""),
        ("<article><div class='share'><div>x</div>y</div><p>a<p>b</article>", "a\nb"),
    ],
)
def test_main_text(inner, expected):
    assert html.main_text(PAGE % inner) == expected


PROSE = ("The river of the town is in the valley and it was there that they had been for all of the day. " * 4).strip()
LISTED = "Megapixel zoom titanium bracket waterproof aluminium tripod discount voucher bundle premium gadget outlet warehouse clearance shipping"
LISTED += " " + LISTED


def test_an_article_is_one_feature_of_a_block():
    teaser = f"<div><p>{PROSE}</p><p>{PROSE}</p></div><article><p>The next of the posts.</p></article>"
    assert html.main_text(teaser).startswith(f"{PROSE}\n{PROSE}")
    # stop words decide inside too, but not in a language of which none are known
    assert html.main_text(f"<main><p>{PROSE}</p><p>{LISTED}</p><p>{PROSE}</p></main>") == f"{PROSE}\n{PROSE}"
    assert html.main_text(f"<main><p>{LISTED}</p></main>") == LISTED
    assert html.main_text(f"<article><p>{PROSE}</p><p>So it was.</p></article><div>A short line.</div>") == f"{PROSE}\nSo it was."


@pytest.mark.parametrize("page", [
    "<article><p class=notice>Cookies<p>{0}<p>{0}</article>", "<ul><li class=share>Tweet<li>item</ul><p>{0}<p>{0}",
    "<div class='content no-sidebar'><p>{0}</p><p>{0}</p></div>", "<article class='post comments-open'><p>{0}</p><p>{0}</p></article>",
    "<div class='search-result-article'><p>{0}</p><p>{0}</p></div>", "<div id='main' class='has-sidebar'><p>{0}</p><p>{0}</p></div>",
    "<section class='story ad-free'><p>{0}</p><p>{0}</p></section>", "<div class=ad>Buy</div></div><p>{0}</p><p>{0}</p>",
    "<div><div class=ad>Buy now</div><p>{0}</p></div><p>{0}</p>", "<div><div class=ad>Buy now</section></div><p>{0}</p><p>{0}</p>",
    "<div class=widget><main><p>{0}</p><p>{0}</p></main></div>", "<table><tr><td class=ad>Buy<td><p>{0}<p>{0}</table>",
    "<main><p>{0}</p><p>{0}</p></main><div class='comment-list'><article class=comment><p>{0} Me too.</p></article></div>",
    "<nav><ul><li>Home<li>News</ul></nav><p>{0}</p><p>{0}</p><footer><p>{0}</footer>", "<dl><dt class=promo>Sale<dd>now</dl><p>{0}<p>{0}",
])
def test_marks_and_missing_end_tags_cost_no_article(page):
    lines = [t for t in html.main_text(page.format(PROSE)).split("\n") if t not in ("item", "now")]
    assert lines == [PROSE, PROSE]


def test_an_advert_that_never_ends_leaves_the_article():
    text = html.main_text(f"<article><div class=ad>Buy<p>{PROSE}</p><p>{PROSE}</p></article>")
    assert text.split("\n")[-2:] == [PROSE, PROSE]


def test_broken_pages_take_one_scan():
    start = time.monotonic()
    for piece in ("<a href='", "<script ", "<script>", "<!-- ", "<", "<p title=\"", "<div class=ad>", "</p>", "<li>", "&amp;", "'<b>\"", "<svg", "<td><p>"):
        page = f"<p>{PROSE}</p>" + piece * (1_000_000 // len(piece))
        assert html.main_text(page).startswith(PROSE[:40]), piece
    assert time.monotonic() - start < 60


def test_tags_are_cut_as_written():
    """Random markup: what stands between the tags, read back in order, is the page without them."""
    rnd = random.Random(3)
    for _ in range(200):
        parts = [rnd.choice(["word ", "<b>", "</b>", "<i a='>'>", "<img src=x>", "a < b", "<!-- <p> -->", "<script>if (a<b) {}</script>", "&lt;", "5 > 4 "]) for _ in range(30)]
        texts = [t for t, *_ in html._tags("".join(parts))]
        want = "".join(" " if p.startswith(("<!--", "<script")) else "" if p[0] == "<" else p for p in parts)
        assert "".join(texts) == want


def test_odd_pages(spark):
    assert [html.main_text(p) for p in (None, "", "   ", "<", "<p", "plain", "a < b & c", "<script>x", "<p>x</p", "<div><div><p>deep")] == [
        "", "", "", "<", "", "plain", "a < b & c", "", "x", "deep",
    ]
    rows = [(1, "u", "<article><p>x</p></article>", "old", 1), (1, None, None, "old", 2), (None, "u", "", None, 3)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, label int")
    got = html.extract(pages)
    assert got.columns == pages.columns
    assert H.multiset((r.page_id, r.text, r.label) for r in got.collect()) == H.multiset([(1, "x", 1), (1, "", 2), (None, "", 3)])
    assert html.extract(pages.limit(0)).count() == 0


def test_toxicity(spark, awkward, nothing):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abdeghilnorst") for _ in range(rnd.randint(2, 9))) for _ in range(400)]
    bad = ["vileword", "nastyone", "grimx"]
    rows, labels = [], []
    for i in range(600):
        w = [rnd.choice(words) for _ in range(rnd.randint(20, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                w.insert(rnd.randrange(len(w)), rnd.choice(bad))
        rows.append((i, " ".join(w)))
        if i % 3:
            labels.append((i, int(toxic)))
    rows += [(None, None), (900, ""), (901, "grimxes " * 3), (902, "word " * 30_000), (903, rows[5][1]), (5, rows[5][1])]
    labels += [(None, 1), (7, None), (5000, 1), (10, 1), (10, 1)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, toxic int").repartition(3)
    table = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = toxicity.score(docs, table).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    for r in got:
        if r.doc_id is not None and r.doc_id < 600:
            assert r.predicted == (r.doc_id % 5 == 0), r
            assert bool(r.passages) == bool(r.predicted)
    # labels of the held-out fold change nothing
    fold = {r.doc_id for r in got if r.held_out}
    other = spark.createDataFrame([(d, 1 - t if d in fold and t is not None else t) for d, t in labels], "doc_id bigint, toxic int")
    again = toxicity.score(docs, other).collect()
    assert H.multiset((r.doc_id, r.score) for r in got) == H.multiset((r.doc_id, r.score) for r in again)
    kept = toxicity.without_toxic(docs, table)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}
    plain = toxicity.score(awkward[2], table.limit(0))
    assert plain.count() == len(awkward[0]) and plain.filter("predicted = 1").count() == 0
    assert toxicity.score(nothing, table).count() == 0
