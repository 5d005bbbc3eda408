"""Toxic passages by maximum-scoring segments of token log-odds.

Terms are words and, for inflected or unseen words, their first letters. A term's score is its
log-odds between toxic and other labelled documents under Dirichlet priors taken from the whole
corpus, kept if it is significant. Along a document the scores of toxic terms rise above a steady
drift downwards, and one linear scan finds all maximal segments. How surprising a segment is
follows from the extreme-value law of such scores under the rates of terms, per word, in documents
that are not toxic. A logistic curve turns what the segments say into a probability: the evidence
of the significant ones, the score of the best one whether significant or not, the density of
toxic terms, what significant terms of the other class take off, and the length.

The curve is fitted on labelled documents scored by models that did not see them: the sample is
dealt to folds, terms are learned without each fold in turn and scan that fold, so that the curve
meets evidence as weak as that of new documents. The final model learns from the whole sample.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.winnowing import identity, with_identity
from terrapanel.session import checkpointed, release

#: Labelled documents that a model is fitted on, about; a documented bound, the rest is not needed.
MOST_LABELLED = 200_000
#: Folds of the sample, each scored without its own labels to fit the curve.
FOLDS = 4
#: Letters of a word's beginning that stand for it.
STEM = 4
#: Prior documents of each class, spread over terms as the corpus is.
PRIOR = 200.0
#: Significance, labelled documents and score that make a term.
LEAST_Z = 3.0
LEAST_SEEN = 3
LEAST_SCORE = 1.0
#: Standard errors taken off a term's log-odds.
CAUTION = 1.0
DRIFT = 0.1
#: Expected false segments in a document below which a segment counts.
LARGEST_E = 0.05
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
REMEMBERED_WORDS = 80_000
#: What the curve weighs, from the columns of ``passages``.
FEATURES = ("sqrt(evidence)", "best", "toxic_terms / sqrt(n_words + 1D)", "other_terms / sqrt(n_words + 1D)", "ln(n_words + 1D)")


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that no label is learned from: crc32 of the id as text, mod 5, is 0."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


@dataclass
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    decay: float  # lambda of the extreme-value law
    #: Weights of ``FEATURES`` and, last, the constant.
    curve: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0, 0.0, -3.0)


def segments(at: np.ndarray, gain: np.ndarray, drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) in one pass.

    Places ``at`` score ``gain`` > 0, all others ``-drift``. A stack of candidates keeps for each
    the nearest earlier one with a smaller sum before it, so every step is amortised.
    """
    found: list[list] = []  # sum before, sum after, start, end, index of the nearest lower one
    total, last = 0.0, -1
    for place, score in zip(at.tolist(), gain.tolist()):
        total -= drift * (place - last - 1)
        now = [total, total + score, place, place + 1, -1]
        total, last = now[1], place
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= now[0]:
                j = found[j][4]
            if j < 0 or found[j][1] >= now[1]:
                now[4] = j
                found.append(now)
                break
            now = [found[j][0], now[1], found[j][2], now[3], -1]
            del found[j:]
    return [(s, e, r - b) for b, r, s, e, _ in found]


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """doc_id, toxic and fold of about ``most`` training documents, one for each text.

    Labels that are null are no labels; where an id has several, their majority counts.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.avg("toxic").alias("toxic"))
    n = known.count()
    if n > most:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * most / n))
    known = checkpointed(known)
    # its size has just been bounded
    texts = docs.select("doc_id", F.xxhash64("text").alias("h")).join(F.broadcast(known), "doc_id")
    one = texts.groupBy("h").agg(F.min("doc_id").alias("doc_id"), (F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    return checkpointed(one.select("doc_id", "toxic", F.pmod("h", F.lit(FOLDS)).cast("int").alias("fold")))


def _counts(kind: str) -> list[str]:
    return [f"{kind}_{f}" for f in range(FOLDS)]


def term_counts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """word, occurrences in all documents and, per fold of the sample, documents of either class that have it
    and its occurrences in those that are not toxic."""
    marked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id", "left")
    names = ["word", "n", *_counts("n0"), *_counts("n1"), *_counts("o0")]
    kinds = [pa.string(), *[pa.int64()] * (len(names) - 1)]

    def count(batches):
        from collections import Counter

        everywhere, ours = Counter(), [Counter() for _ in range(3 * FOLDS)]

        def rows():
            words = list(everywhere)
            columns = [words, list(everywhere.values()), *([c.get(w, 0) for w in words] for c in ours)]
            for c in (everywhere, *ours):
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

        for b in batches:
            for text, label, fold in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = _WORD.findall((text.as_py() or "").lower())
                everywhere.update(words)
                if label is not None:
                    ours[fold + FOLDS * label].update(set(words))
                    if not label:
                        ours[fold + 2 * FOLDS].update(words)
                if len(everywhere) > REMEMBERED_WORDS:
                    yield rows()
        if everywhere:
            yield rows()

    each = marked.select(F.col("text").cast("string"), F.col("toxic"), F.col("fold"))
    each = each.mapInArrow(count, ", ".join(["word string", *[f"{c} bigint" for c in names[1:]]]))
    return each.groupBy("word").agg(*(F.sum(c).alias(c) for c in names[1:]))


def _sum(kind: str, without: int | None) -> Column:
    parts = [F.col(f"{kind}_{f}") for f in range(FOLDS) if f != without]
    return sum(parts[1:], parts[0])


def _scored(counts: DataFrame, documents: dict[int | None, tuple[int, int]], occurrences: int) -> DataFrame:
    """word, and for each model (all but one fold, then all) the score and the rate of a significant term.

    The score is the log-odds with Dirichlet priors, drawn back by its standard error; null where not significant.
    """
    prior = F.col("n") / occurrences * PRIOR + 0.01
    scores = []
    for without, (a, b) in documents.items():
        n0, n1 = _sum("n0", without), _sum("n1", without)
        d0, d1 = float(a) + PRIOR, float(b) + PRIOR
        y0, y1 = n0 + prior, n1 + prior
        odds = F.log(y1 / F.greatest(F.lit(d1) - y1, F.lit(0.5))) - F.log(y0 / F.greatest(F.lit(d0) - y0, F.lit(0.5)))
        z = odds / F.sqrt(1 / (y1 + 0.5) + 1 / (y0 + 0.5))
        back = CAUTION * F.least(F.sqrt(1 / y1 + 1 / y0), F.lit(3.0))
        up = F.least(odds, F.lit(12.0)) - back
        down = F.greatest(odds, F.lit(-12.0)) + back
        toxic, other = (z >= LEAST_Z) & (n1 >= LEAST_SEEN) & (up > LEAST_SCORE), (z <= -LEAST_Z) & (n0 >= LEAST_SEEN) & (down < 0.0)
        scores.append(F.when(toxic, up).when(other, down))
    rates = [_sum("o0", without) for without in documents]
    out = counts.select("word", F.array(*scores).alias("scores"), F.array(*rates).alias("seen"))
    return out.filter(F.exists("scores", lambda x: x.isNotNull()))


def decay(scores: np.ndarray, chance: np.ndarray, drift: float = DRIFT) -> float:
    """The positive root of E[exp(x * score)] = 1 under the background."""
    rest = max(0.0, 1.0 - chance.sum())

    def over(x: float) -> float:
        return rest * math.exp(-x * drift) + float((chance * np.exp(x * scores)).sum()) - 1.0

    low, high = 1e-6, 4.0
    if not len(scores) or over(high) < 0:
        return high
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if over(mid) < 0 else (low, mid)
    return low


def fit_terms(docs: DataFrame, sample: DataFrame) -> list[Model]:
    """Models of the sample without each fold in turn and, last, of the whole sample.

    The driver receives the significant terms, whose number the sample's vocabulary bounds.
    """
    found = {(r["fold"], r["toxic"]): r["n"] for r in sample.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted: list[int | None] = [*range(FOLDS), None]
    documents = {w: tuple(sum(n for (f, t), n in found.items() if t == k and f != w) for k in (0, 1)) for w in wanted}
    if not all(documents[None]):
        return [Model({}, {}, 1.0)] * len(wanted)
    counts = checkpointed(term_counts(docs, sample))
    names = [c for c in counts.columns if c != "word"]
    stems = counts.groupBy(F.substring("word", 1, STEM).alias("word")).agg(*[F.sum(c).alias(c) for c in names])
    totals = counts.agg(*[F.sum(c).alias(c) for c in names]).first()
    terms = (
        _scored(counts, documents, totals["n"]).select(F.lit(0).alias("stem"), "*")
        .unionByName(_scored(stems, documents, totals["n"]).select(F.lit(1).alias("stem"), "*"))
    ).collect()
    release(counts)
    models = []
    for k, without in enumerate(wanted):
        words = {t["word"]: (t["scores"][k], t["seen"][k]) for t in terms if not t["stem"] and t["scores"][k] is not None}
        heads = {t["word"]: (t["scores"][k], t["seen"][k]) for t in terms if t["stem"] and t["scores"][k] is not None}
        # A stem scores only words without a score of their own.
        own: dict[str, int] = {}
        for w, (_, seen) in words.items():
            own[w[:STEM]] = own.get(w[:STEM], 0) + seen
        rated = [*words.values(), *((score, max(0, seen - own.get(w, 0))) for w, (score, seen) in heads.items())]
        rated = [(score, seen) for score, seen in rated if score > 0]
        length = sum(totals[f"o0_{f}"] for f in range(FOLDS) if f != without) or 1
        # a term never seen in such documents may be next time
        chance = np.array([(seen + 0.5) / (length + 0.5 * len(rated)) for _, seen in rated])
        models.append(Model(
            {w: x for w, (x, _) in words.items()}, {w: x for w, (x, _) in heads.items()},
            decay(np.array([x for x, _ in rated]), chance),
        ))
    return models


class _Scores(dict):
    """Score of a word: its own, else that of its stem."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        score = self[word] = self.model.words.get(word) or self.model.stems.get(word[:STEM], 0.0)
        return score


_PASSAGES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))


def scan_text(words: list[str], scores, decay: float) -> tuple[float, float, float, float, list[dict]]:
    """Evidence, best segment (in nats), sums of toxic and of other terms' scores, and significant passages."""
    gain = np.fromiter(map(scores.__getitem__, words), dtype=np.float64, count=len(words))
    at = np.flatnonzero(gain > 0)
    found, evidence, best = [], 0.0, 0.0
    for start, end, score in segments(at, gain[at]) if len(at) else ():
        best = max(best, decay * score)
        bits = decay * score - math.log(len(words) + 1)
        if math.exp(-min(bits, 700.0)) <= LARGEST_E:
            found.append({"start": start, "end": end, "score": score, "e_value": math.exp(-min(bits, 700.0))})
            evidence += bits
    return evidence, best, float(gain[at].sum()), float(gain[gain < 0].sum()), found


def passages(docs: DataFrame, models: list[Model]) -> DataFrame:
    """doc_id, identity, n_words, what the segments say, and the significant passages (in words) of every document.

    ``docs`` may have a column fold, the number of the model to scan with; else the last one scans.
    """
    numbers = ("evidence", "best", "toxic_terms", "other_terms")
    schema = pa.schema([
        ("doc_id", pa.int64()), ("_key_a", pa.int64()), ("_key_b", pa.int64()), ("n_words", pa.int64()), *[(c, pa.float64()) for c in numbers],
        ("passages", _PASSAGES),
    ])

    def scan(batches):
        scores = [_Scores(m) for m in models]
        for b in batches:
            rows = []
            for *key, fold, text in zip(*(c.to_pylist() for c in b.columns[:4]), b.column(4)):
                if len(scores[fold]) > REMEMBERED_WORDS:
                    scores[fold].clear()
                words = _WORD.findall((text.as_py() or "").lower())
                rows.append((*key, len(words), *scan_text(words, scores[fold], models[fold].decay)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    ddl = (
        f"doc_id bigint, _key_a bigint, _key_b bigint, n_words bigint, {', '.join(c + ' double' for c in numbers)}, "
        "passages array<struct<start:int,end:int,score:double,e_value:double>>"
    )
    fold = F.col("fold") if "fold" in docs.columns else F.lit(len(models) - 1)
    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *identity("doc_id", "text"), fold.alias("fold"), F.col("text").cast("string"))
    return read.mapInArrow(scan, ddl)


def fit_curve(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Weights of the columns of ``x`` and a constant, by logistic regression with a light ridge on standard scores."""
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = np.inf  # a constant column has no say
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    ridge = np.array([1.0] * x.shape[1] + [1e-3])
    w = np.zeros(z.shape[1])
    w[-1] = math.log((toxic.sum() + 0.5) / (len(toxic) - toxic.sum() + 0.5))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (toxic - p) - ridge * w
        bend = (z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge)
        step = np.clip(np.linalg.solve(bend, slope), -2, 2)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())


def calibrate(docs: DataFrame, models: list[Model], sample: DataFrame) -> Model:
    """The last model with a curve fitted on the sample, each fold scanned by the model without it."""
    mine = docs.join(F.broadcast(sample), "doc_id")
    seen = passages(mine, models).select("doc_id", *[F.expr(f).alias(f"f{i}") for i, f in enumerate(FEATURES)])
    # A sample document may have copies under its id; the sample's size bounds what is collected.
    one = seen.groupBy("doc_id").agg(*[F.max(f"f{i}").alias(f"f{i}") for i in range(len(FEATURES))])
    rows = one.join(F.broadcast(sample), "doc_id").select("toxic", *[f"f{i}" for i in range(len(FEATURES))]).collect()
    final = models[-1]
    if rows:
        table = np.array(rows, dtype=float)
        final.curve = tuple(float(v) for v in fit_curve(table[:, 1:], table[:, 0]))
    return final


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): held_out, score, predicted, n_words, evidence, passages.

    Only ``labels`` (doc_id, toxic) outside the held-out fold are learned from. Null and empty
    texts have no evidence and get the curve's score of none. A null id counts as held out.
    Repeated rows are scored alike. Without labels of both classes no term scores, and the score
    follows the share of toxic labels (0.05 without any). Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    sample = labelled_sample(docs, labels)
    models = fit_terms(docs, sample)
    model = calibrate(docs, models, sample)
    scored = passages(docs, [model])
    *weights, constant = model.curve
    at = sum((F.lit(w) * F.expr(f) for w, f in zip(weights, FEATURES)), F.lit(constant))
    probability = 1 / (1 + F.exp(-at))
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        probability.alias("score"),
        (probability >= 0.5).cast("int").alias("predicted"),
        "n_words",
        "evidence",
        "passages",
        "_key_a",
        "_key_b",
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    keys = ["_key_a", "_key_b"]
    bad = checkpointed(score(docs, labels).filter("predicted = 1").select(*keys).distinct())
    return with_identity(docs).join(bad.hint("merge"), keys, "left_anti").select("row.*")
