"""Toxicity scores against a plain recomputation of counts, terms, segments and evidence."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from terrapanel.llm import toxicity as T


def best_segments(scores):
    """All maximal segments by definition: the best run, then the same on either side of it."""
    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 0 and (best is None or total > best[0] + 1e-12):
                best = (total, i, j + 1)
    if best is None:
        return []
    total, i, j = best
    left, right = best_segments(scores[:i]), best_segments(scores[j:])
    return left + [(i, j, total)] + [(a + j, b + j, s) for a, b, s in right]


def learn(rows, folds, without):
    """(scores of words, scores of stems, decay) from labelled (text, toxic, fold) rows and the corpus."""
    corpus, n, o = Counter(), (Counter(), Counter()), Counter()
    documents = [0, 0]
    for text, label, fold in rows:
        words = T._WORD.findall((text or "").lower())
        corpus.update(words)
        if label is not None and fold != without:
            documents[label] += 1
            n[label].update(set(words))
            if not label:
                o.update(words)
    every = sum(corpus.values())

    def score(k, total, n0, n1):
        prior = total / every * T.PRIOR + 0.01
        y0, y1 = n0 + prior, n1 + prior
        odds = math.log(y1 / max(documents[1] + T.PRIOR - y1, 0.5)) - math.log(y0 / max(documents[0] + T.PRIOR - y0, 0.5))
        z = odds / math.sqrt(1 / (y1 + 0.5) + 1 / (y0 + 0.5))
        back = T.CAUTION * min(math.sqrt(1 / y1 + 1 / y0), 3.0)
        up, down = min(odds, 12.0) - back, max(odds, -12.0) + back
        if z >= T.LEAST_Z and n1 >= T.LEAST_SEEN and up > T.LEAST_SCORE:
            return up
        return down if z <= -T.LEAST_Z and n0 >= T.LEAST_SEEN and down < 0 else None

    stems = {}
    for w, total in corpus.items():
        s = stems.setdefault(w[: T.STEM], [0, 0, 0, 0])
        for k, v in enumerate((total, n[0][w], n[1][w], o[w])):
            s[k] += v
    words = {w: (x, o[w]) for w, total in corpus.items() if (x := score(w, total, n[0][w], n[1][w])) is not None}
    heads = {w: (x, s[3]) for w, s in stems.items() if (x := score(w, *s[:3])) is not None}
    own = Counter()
    for w, (_, seen) in words.items():
        own[w[: T.STEM]] += seen
    rated = [v for v in words.values() if v[0] > 0] + [(x, max(0, s - own[w])) for w, (x, s) in heads.items() if x > 0]
    length = sum(o.values()) or 1
    chance = np.array([(s + 0.5) / (length + 0.5 * len(rated)) for _, s in rated])
    return {w: x for w, (x, _) in words.items()}, {w: x for w, (x, _) in heads.items()}, T.decay(np.array([x for x, _ in rated]), chance)


def features(text, model):
    words, stems, decay = model
    found = T._WORD.findall((text or "").lower())
    gain = [words.get(w) or stems.get(w[: T.STEM], 0.0) for w in found]
    evidence, best, spans = 0.0, 0.0, []
    for a, b, s in best_segments([g if g > 0 else -T.DRIFT for g in gain]):
        best = max(best, decay * s)
        bits = decay * s - math.log(len(found) + 1)
        if math.exp(-min(bits, 700)) <= T.LARGEST_E:
            evidence += bits
            spans.append((a, b))
    root = math.sqrt(len(found) + 1)
    return [math.sqrt(evidence), best, sum(g for g in gain if g > 0) / root, sum(g for g in gain if g < 0) / root, math.log(len(found) + 1)], spans


def test_scores_by_plain_recomputation(spark):
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 7))) for _ in range(150)]
    bad = ["grumblik", "grumblor", "zzurk", "nastor", "vileness"]
    rows, labels = [], []
    for i in range(700):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(3, 40))]
        toxic = rnd.random() < 0.25
        if toxic and rnd.random() < 0.9:
            at = rnd.randrange(len(words))
            words[at:at] = [rnd.choice(bad) for _ in range(rnd.randint(1, 4))]
        rows.append((i, " ".join(words).title() + f" {i}"))
        if i % 3:
            labels.append((i, int(toxic)))
    rows += [(700, None), (701, ""), (702, "grumblak zzurk")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    table = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    sample = {r.doc_id: (r.toxic, r.fold) for r in T.labelled_sample(docs, table).collect()}
    assert set(sample) == {i for i, _ in labels if zlib.crc32(str(i).encode()) % 5}
    marked = [(t, *sample.get(i, (None, None))) for i, t in rows]
    models = [learn(marked, sample, f) for f in (*range(T.FOLDS), None)]
    fitted = T.fit_terms(docs, T.labelled_sample(docs, table))
    for m, (words, stems, decay) in zip(fitted, models):
        assert m.words == pytest.approx(words) and m.stems == pytest.approx(stems) and m.decay == pytest.approx(decay)
    text = dict(rows)
    x = np.array([features(text[i], models[fold])[0] for i, (_, fold) in sample.items()])
    curve = T.fit_curve(x, np.array([float(t) for t, _ in sample.values()]))
    got = T.score(docs, table).collect()
    assert len(got) == len(rows)
    for r in got:
        values, spans = features(text[r.doc_id], models[-1])
        want = 1 / (1 + math.exp(-(np.dot(curve[:-1], values) + curve[-1])))
        assert r.score == pytest.approx(want, rel=1e-6) and r.predicted == int(want >= 0.5)
        assert [(p.start, p.end) for p in r.passages] == spans
    caught = [r.score for r in got if "Grumbl" in (text[r.doc_id] or "") or "Zzurk" in (text[r.doc_id] or "")]
    assert np.mean(np.array(caught) >= 0.5) > 0.9


def test_curve_weighs_what_separates():
    rng = np.random.default_rng(1)
    toxic = (rng.random(2000) < 0.2).astype(float)
    x = np.column_stack([toxic * 3 + rng.normal(size=2000), rng.normal(size=2000), np.full(2000, 7.0)])
    w = T.fit_curve(x, toxic)
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert abs(p.mean() - toxic.mean()) < 0.01 and w[0] > 1 and abs(w[1]) < 0.3 and w[2] == 0


def test_held_out_labels_are_never_read(spark):
    rows = [(i, f"word{i % 9} grumblik" if i % 4 == 0 else f"word{i % 9}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = [(i, int(i % 4 == 0)) for i, _ in rows]
    other = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    one, two = (T.score(docs, spark.createDataFrame(x, "doc_id bigint, toxic int")).select("doc_id", "score").orderBy("doc_id").collect() for x in (labels, other))
    assert one == two
