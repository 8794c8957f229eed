"""Toxicity scores from non-negative positive-unlabelled learning.

Only confirmed toxic documents serve as labelled examples; the rest of what the
classifier sees is unlabelled text.  With class prior p, the risk of a scorer g is

    p * E_P[loss(g)] + max(0, E_U[loss(-g)] - p * E_P[loss(-g)]),

whose second term stands for the risk on clean documents and must not fall below zero;
where it does, the step goes the other way (without that, a bias that flags every text
has the least risk of all).  g is linear in words and word beginnings: whether a text holds them, twice, four times.

The examples are bounded samples (``max_positive`` and ``max_unlabelled`` rows by
hash order).  Spark counts the features over them and keeps the significant ones; the
driver trains in numpy on their sparse rows and sets the weight decay by
cross-validation among them.  Every document is then scored whole, batch by batch.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from itertools import chain
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, free_name

_words = re.compile(r"\w+").findall
PREFIXES = (3, 4, 5, 6, 7, 8)
LEVELS = (1, 2, 4)
DECAYS = (1e-3, 3e-4, 1e-4)
#: Characters of the texts whose features a task counts together; a longer text is counted alone.
CHARS_AT_ONCE = 1_000_000
#: Words whose bases a task keeps, and the most letters of one; others are looked up again.
WORDS_KEPT, LONGEST_KEPT = 100_000, 40


def bases(word: str) -> list[str]:
    """The word and its beginnings, these with an asterisk."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


def text_features(text: str | None) -> set[str]:
    """Lower-case words, and their first letters marked with an asterisk; with a number behind if they occur so often at least."""
    return KnownFeatures().of(text)


def named(base: str, level: int) -> str:
    return base if level == 1 else f"{base} {level}"


class KnownFeatures:
    """Finds which of a set of features texts have, or all their features; a word's bases are looked up once."""

    def __init__(self, features: Iterable[str] | None = None):
        self.features = None if features is None else set(features)
        # Words share the text of their bases.
        self.bases = None if features is None else {b: b for b in (f.split(" ")[0] for f in self.features)}
        self.of_word: dict[str, tuple[str, ...]] = {}

    def _bases(self, word: str) -> tuple[str, ...]:
        found = self.of_word.get(word)
        if found is None:
            found = tuple(bases(word)) if self.bases is None else tuple(self.bases[b] for b in bases(word) if b in self.bases)
            if len(word) <= LONGEST_KEPT:
                if len(self.of_word) >= WORDS_KEPT:
                    self.of_word.clear()
                self.of_word[word] = found
        return found

    def of(self, text: str | None) -> set[str]:
        times: Counter[str] = Counter()
        for w, k in Counter(_words((text or "").lower())).items():
            for base in self._bases(w):
                times[base] += k
        names = (named(b, level) for b, k in times.items() for level in LEVELS if k >= level)
        return set(names) if self.features is None else self.features.intersection(names)


def feature_counts(texts: Sequence[str | None], positive: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The ``text_features`` of the texts, and how many of the positive and of the other texts have each, counted for all texts at once."""
    word_number: dict[str, int] = {}
    words = [_words((t or "").lower()) for t in texts]
    doc = np.repeat(np.arange(len(texts)), [len(ws) for ws in words])
    word = np.fromiter((word_number.setdefault(w, len(word_number)) for ws in words for w in ws), np.int64, len(doc))
    if not len(word):
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs, times = np.unique(doc * len(word_number) + word, return_counts=True)
    doc, word = np.divmod(pairs, len(word_number))
    base_number: dict[str, int] = {}
    of_word = [[base_number.setdefault(f, len(base_number)) for f in bases(w)] for w in word_number]
    width = np.array([len(b) for b in of_word])
    flat, start = np.fromiter(chain.from_iterable(of_word), np.int64, width.sum()), np.cumsum(width) - width
    # Each word of a text becomes its bases, which are added up by text.
    n = width[word]
    at = np.repeat(start[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    pairs, place = np.unique(np.repeat(doc, n) * len(base_number) + flat[at], return_inverse=True)
    times = np.bincount(place, np.repeat(times, n))
    doc, base = np.divmod(pairs, len(base_number))
    by_number, names = list(base_number), []
    counts: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
    for level in LEVELS:
        often = times >= level
        p, u = (np.bincount(base[often & (positive[doc] == side)], minlength=len(base_number)) for side in (True, False))
        used = np.flatnonzero(p + u)
        names += [named(by_number[k], level) for k in used]
        counts[0].append(p[used])
        counts[1].append(u[used])
    return names, np.concatenate(counts[0]), np.concatenate(counts[1])


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    @cached_property
    def known(self) -> KnownFeatures:
        return KnownFeatures(self.weights)

    def score(self, text: str | None) -> float:
        g = self.bias + sum(self.weights[f] for f in sorted(self.known.of(text)))
        return float(1 / (1 + np.exp(-np.clip(g, -40, 40))))


def held_out(id_: Column) -> Column:
    """Whether the id's fold keeps its label from training; null ids do."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train_nnpu(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], features: int, prior: float, *, rounds: int = 400, rate: float = 0.1, l2: float = 3e-4
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk; each row is an array of feature numbers."""

    def sparse(rows: list[np.ndarray]):
        n = np.array([len(r) for r in rows], np.int64)
        return np.repeat(np.arange(len(rows)), n), (np.concatenate(rows) if len(rows) else np.zeros(0)).astype(np.int64)

    p_row, p_col = sparse(positive)
    u_row, u_col = sparse(unlabelled)
    w, b = np.zeros(features), np.log(prior / (1 - prior))
    m, v = np.zeros(features + 1), np.zeros(features + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    loss = lambda z: np.logaddexp(0, -z)
    for t in range(1, rounds + 1):
        gp = b + np.bincount(p_row, w[p_col], minlength=len(positive))
        gu = b + np.bincount(u_row, w[u_col], minlength=len(unlabelled))
        clean_risk = loss(-gu).mean() - prior * loss(-gp).mean()
        # Derivatives by g: loss(g) has sigmoid(g) - 1, loss(-g) has sigmoid(g).
        on_p = prior * (sigmoid(gp) - 1) / len(gp)
        clean_p, clean_u = -prior * sigmoid(gp) / len(gp), sigmoid(gu) / len(gu)
        if clean_risk >= 0:
            dp, du = on_p + clean_p, clean_u
        else:
            dp, du = -clean_p, -clean_u
        grad = np.append(np.bincount(p_col, dp[p_row], minlength=features) + np.bincount(u_col, du[u_row], minlength=features) + l2 * w, dp.sum() + du.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def zero_one_risk(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, w: np.ndarray, b: float) -> float:
    """The non-negative risk where the loss counts mistakes."""
    hit, flagged = (np.mean([b + w[x].sum() >= 0 for x in rows]) for rows in (positive, unlabelled))
    return float(prior * (1 - hit) + max(0.0, flagged - prior * hit))


def best_decay(positive: list[np.ndarray], unlabelled: list[np.ndarray], features: int, prior: float, decays: Sequence[float] = DECAYS, *, folds: int = 3) -> float:
    """The weight decay of the least risk on rows left out of training; of equal ones the first."""
    if len(decays) == 1 or min(len(positive), len(unlabelled)) < folds:
        return decays[0]
    risk = np.zeros(len(decays))
    for k in range(folds):
        part = lambda rows, out, k=k: [x for i, x in enumerate(rows) if (i % folds == k) == out]
        for d, l2 in enumerate(decays):
            w, b = train_nnpu(part(positive, False), part(unlabelled, False), features, prior, l2=l2)
            risk[d] += zero_one_risk(part(positive, True), part(unlabelled, True), prior, w, b)
    return decays[int(risk.round(9).argmin())]


def significance(p: Column, u: Column, n_p: int, n_u: int) -> Column:
    """The root of the likelihood ratio statistic for equal rates, given p of n_p toxic and u of n_u unlabelled examples; about normal even for rare features."""
    rate = (p + u) / (n_p + n_u)
    part = lambda k, expected: F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)
    parts = [part(k, n * r) for k, n, r in ((p, n_p, rate), (n_p - p, n_p, 1 - rate), (u, n_u, rate), (n_u - u, n_u, 1 - rate))]
    return F.sqrt(F.greatest(2 * sum(parts[1:], parts[0]), F.lit(0.0)))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_positive: int = 3000,
    max_unlabelled: int = 20_000,
    max_features: int = 32_768,
    least_documents: int = 5,
    level: float = 0.05,
    decays: Sequence[float] = DECAYS,
) -> Model:
    """Train on ``labels`` outside the held-out fold; the class prior is the toxic part of those rows.

    Features of ``least_documents`` examples or more are tested, and those count whose
    rates among toxic and unlabelled ones differ at ``level``, divided by the number of
    tests: at any size, chance lets one pass with that probability at most.  Past
    ``max_features``, a bound for the driver, the least significant ones go.  Unlabelled text comes from all
    documents outside the held-out fold, labels ignored: their toxic part is the prior,
    however many of them have labels.  Without toxic examples or text every score is the
    prior (0 without labels).

    Null ids and null labels teach nothing.  Of rows that repeat an id the smallest text
    is the example, so an id is one example of a kind.  An id labelled both ways is a
    toxic example, and the prior counts each of its labels.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).select(id_col, F.col(label_col).cast("int").alias("y"))
    counted = known.agg(F.count("y").alias("n"), F.sum("y").alias("k")).first()
    prior = (counted["k"] or 0) / counted["n"] if counted["n"] else 0.0
    order = [F.xxhash64(id_col), F.col(id_col)]
    ids = docs.select(id_col).where(~held_out(F.col(id_col))).distinct()
    chosen = known.where("y = 1").select(id_col).distinct().join(ids, id_col, "left_semi").orderBy(*order).limit(max_positive)
    other = ids.orderBy(*order).limit(max_unlabelled)
    # At most max_positive + max_unlabelled rows.
    picked = durable(chosen.select(id_col, F.lit(True).alias("p")).unionByName(other.select(id_col, F.lit(False).alias("p"))))
    n_p, n_u = picked.agg(F.count_if("p"), F.count_if(~F.col("p"))).first()
    if not n_p or not n_u or not 0 < prior < 1:
        return Model({}, float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9))))
    known_texts = docs.select(id_col, text_col).join(F.broadcast(picked), id_col).repartition(spark.sparkContext.defaultParallelism, id_col)
    sample = durable(known_texts.groupBy(id_col, "p").agg(F.min(text_col).alias(text_col)).select(id_col, text_col, "p"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str | None] = []
        toxic: list[bool] = []
        chars = 0

        def counted() -> pa.RecordBatch:
            names, p, u = feature_counts(texts, np.array(toxic, bool))
            return pa.RecordBatch.from_pydict({"f": pa.array(names, pa.string()), "p": pa.array(p, pa.int64()), "u": pa.array(u, pa.int64())})

        for batch in batches:
            for text, p in zip(batch.column(1), batch.column(2), strict=True):
                texts.append(text.as_py())
                toxic.append(p.as_py())
                chars += len(texts[-1] or "")
                # Sums are made again in Spark, so a task need not hold all features of its rows.
                if chars > CHARS_AT_ONCE:
                    yield counted()
                    texts, toxic, chars = [], [], 0
        yield counted()

    tested = durable(
        sample.mapInArrow(count, "f string, p long, u long")
        .groupBy("f")
        .agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
        .where(F.col("p") + F.col("u") >= least_documents)
    )
    bar = NormalDist().inv_cdf(1 - level / 2 / max(1, tested.count()))
    z = significance(F.col("p"), F.col("u"), n_p, n_u)
    features = sorted(r["f"] for r in tested.withColumn("z", z).where(F.col("z") >= bar).orderBy(F.desc("z"), "f").limit(max_features).collect())
    number = {f: k for k, f in enumerate(features)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = KnownFeatures(number)
        for batch in batches:
            found = [sorted(number[f] for f in known.of(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0).cast(pa.string()), "p": batch.column(2), "x": pa.array(found, pa.list_(pa.int32()))})

    collected = sorted(sample.mapInArrow(rows, "id string, p boolean, x array<int>").collect(), key=lambda r: (r["id"] or "", r["x"]))
    arrays = {p: [np.array(r["x"], np.int64) for r in collected if r["p"] is p] for p in (True, False)}
    l2 = best_decay(arrays[True], arrays[False], len(features), prior, decays)
    weights, bias = train_nnpu(arrays[True], arrays[False], len(features), prior, l2=l2)
    return Model({f: float(w) for f, w in zip(features, weights, strict=True) if abs(w) > 1e-6}, bias)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1; null texts are scored as empty ones.  The name replaces a column of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # max_features weights at most

    @F.pandas_udf("double")
    def run(texts):
        return texts.map(shared.value.score, na_action=None)

    return docs.withColumn(into, run(F.col(text_col)))


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """``docs`` with held_out (boolean), score (double) and predicted (int, 1 from the threshold on)."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    scored = score(docs.drop("held_out", "score", "predicted"), model, text_col=text_col)
    return scored.withColumns({"held_out": held_out(F.col(id_col)), "predicted": (F.col("score") >= threshold).cast("int")})


def without_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents whose score is below the threshold, with their own columns."""
    score_name = free_name(docs, "score")
    model = fit(docs, labels, **{k: v for k, v in options.items() if k != "threshold"})
    return score(docs, model, text_col=options.get("text_col", "text"), into=score_name).where(F.col(score_name) < options.get("threshold", 0.5)).drop(score_name)
