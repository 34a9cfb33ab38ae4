"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Grades: 0 clean, 1 toxic, 2 toxic with at least as many distinct marker words as
the median toxic training document.  One weight per feature is shared by
both thresholds, P(grade >= k) = logistic(w.x - t_k) with t_1 < t_2; the result is
the expected severity P(>=1) + P(>=2).

Features are the distinct lower-cased words of the whole text and their
prefixes (inflected forms share a stem).  The model is fitted on at most
``MAX_LABELLED`` labelled rows (hash order of the ids): feature counts by label
are aggregated over the cluster, the ``MAX_FEATURES`` most telling features are
kept, and the design matrix -- bounded by those two parameters -- is
solved by gradient steps.  Scoring reads every whole text.

Defined results: null and empty texts have no features; of several labels of
one id the largest counts, null labels and null ids do not train; without both
kinds of labels nothing is rejected; rows with equal ids are scored
separately; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.common import lean, save, text_batches

MAX_LABELLED = 20_000       # bound of the training sample (rows)
MAX_FEATURES = 3_000        # bound of the vocabulary
MAX_CANDIDATES = 100_000    # features of toxic rows that are counted in clean rows
MIN_DOCS = 4                # toxic training rows that must hold a feature
HELD_FEATURES = 50_000      # counters of a worker before they are sent
PREFIXES = range(3, 9)
WORD = re.compile(r"\w+")


def word_features(word: str) -> list[str]:
    return [f"={word}", *(word[:n] for n in PREFIXES if n <= len(word))]


def doc_features(text: str | None) -> set[str]:
    return {f for w in set(WORD.findall((text or "").lower())) for f in word_features(w)}


@dataclass
class Model:
    """Weights by feature, ordered thresholds, the probability that rejects."""
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = (math.inf, math.inf)

    def probabilities(self, score: float) -> list[float]:
        return [1 / (1 + math.exp(min(700.0, t - score))) if t < math.inf else 0.0 for t in self.thresholds]


def _count_fn(known_b=None):
    """Feature counts of a batch of texts (of ``known`` features only)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if known_b is None else known_b.value
        for b in batches:
            c: Counter = Counter()
            for t in b.column("text").to_pylist():
                f = doc_features(t)
                c.update(f if known is None else f & known)
                if len(c) > HELD_FEATURES:
                    yield counted(c)
                    c.clear()
            yield counted(c)

    def counted(c):
        return pa.RecordBatch.from_pydict({"feature": pa.array(list(c), pa.string()), "n": pa.array(list(c.values()), pa.int64())})
    return run


def _counts(texts: DataFrame, known_b=None) -> DataFrame:
    return texts.select("text").mapInArrow(lean(_count_fn(known_b)), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def _design_fn(index_b, strong_b):
    def run(batches):
        index, strong = index_b.value, strong_b.value
        for b in batches:
            cols, marks = [], []
            for t in b.column("text").to_pylist():
                words = set(WORD.findall((t or "").lower()))
                cols.append(sorted({index[f] for w in words for f in word_features(w) if f in index}))
                marks.append(sum(any(f in strong for f in word_features(w)) for w in words))
            yield pa.RecordBatch.from_pydict({"toxic": b.column("toxic"), "cols": pa.array(cols, pa.list_(pa.int32())), "marks": pa.array(marks, pa.int64())})
    return run


def g2(a: float, b: float, n_a: float, n_b: float) -> float:
    """Log-likelihood ratio of a feature held by a of n_a and b of n_b rows."""
    total, out = n_a + n_b, 0.0
    for got, n in ((a, n_a), (b, n_b)):
        for x, share in ((got, (a + b) / total), (n - got, 1 - (a + b) / total)):
            if x > 0:
                out += 2 * x * math.log(x / (n * share))
    return out


def solve(cols: Sequence[Sequence[int]], grades: np.ndarray, n_features: int, steps: int = 600, rate: float = 0.5,
          ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of the cumulative-link model (logistic) with a ridge
    penalty, by Adam steps over the whole bounded sample; returns (w, thresholds)."""
    rows = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
    col = np.concatenate([np.asarray(c, np.int64) for c in cols]) if len(rows) else np.zeros(0, np.int64)
    n, k = len(cols), int(grades.max())
    share = np.clip([(grades >= j).mean() for j in range(1, k + 1)], 1e-4, 1 - 1e-4)
    # x = weights, first threshold, logs of the gaps between thresholds
    first = -np.log(share / (1 - share))
    x = np.concatenate((np.zeros(n_features), first[:1], np.log(np.maximum(np.diff(first), 1e-2))))
    m1, m2 = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        w, t = x[:n_features], np.cumsum(np.concatenate((x[n_features:n_features + 1], np.exp(x[n_features + 1:]))))
        s = np.bincount(rows, weights=w[col], minlength=n)
        cdf = 1 / (1 + np.exp(-np.clip(np.concatenate(([-np.inf], t, [np.inf]))[None, :] - s[:, None], -500, 500)))
        cdf[:, 0], cdf[:, -1] = 0, 1
        lo, hi = cdf[np.arange(n), grades], cdf[np.arange(n), grades + 1]
        p = np.maximum(hi - lo, 1e-12)
        g = np.zeros_like(x)
        g[:n_features] = np.bincount(col, weights=(hi + lo - 1)[rows], minlength=n_features) / n - ridge * w
        gt = np.array([(hi * (1 - hi) / p)[grades == j - 1].sum() - (lo * (1 - lo) / p)[grades == j].sum() for j in range(1, k + 1)]) / n
        after = np.cumsum(gt[::-1])[::-1]                       # a gap moves all later thresholds
        g[n_features], g[n_features + 1:] = after[0], after[1:] * np.exp(x[n_features + 1:])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        x = x + rate * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-8)
    return x[:n_features], np.cumsum(np.concatenate((x[n_features:n_features + 1], np.exp(x[n_features + 1:]))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES) -> Model:
    spark = docs.sparkSession
    text_batches(spark)
    known = labels.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("id")).agg(
        (F.max(F.col(f"`{label_col}`").cast("int")) > 0).alias("toxic"))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    # labelled ids that still have a document; the sample is at most max_labelled rows
    sample = save(known.join(texts.select("id").distinct(), "id", "left_semi")
                  .orderBy(F.xxhash64("id", F.lit("toxicity")), "id").limit(max_labelled), "tox-sample")
    train = save(texts.join(F.broadcast(sample), "id").select("toxic", "text"), "tox-train")
    size = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_tox, n_clean = size.get(True, 0), size.get(False, 0)
    if not n_tox or not n_clean:
        return Model()
    top = _counts(train.where("toxic")).where(F.col("n") >= MIN_DOCS).orderBy(F.desc("n"), "feature").limit(MAX_CANDIDATES)
    held = {r["feature"]: r["n"] for r in top.collect()}
    clean = {r["feature"]: r["n"] for r in _counts(train.where("NOT toxic"), spark.sparkContext.broadcast(set(held))).collect()}
    rated = sorted(((g2(a, clean.get(f, 0), n_tox, n_clean), f) for f, a in held.items()), key=lambda x: (-x[0], x[1]))[:max_features]
    vocab = [f for _, f in rated]
    lift = lambda f: (held[f] / n_tox) / ((clean.get(f, 0) + 0.5) / n_clean)
    index_b = spark.sparkContext.broadcast({f: i for i, f in enumerate(vocab)})
    strong_b = spark.sparkContext.broadcast({f for f in vocab if lift(f) >= 10})
    design = train.mapInArrow(lean(_design_fn(index_b, strong_b)), T.StructType([
        T.StructField("toxic", T.BooleanType()), T.StructField("cols", T.ArrayType(T.IntegerType())), T.StructField("marks", T.LongType())])).collect()
    design.sort(key=lambda r: (r["toxic"], r["cols"], r["marks"]))        # the same sums whatever the task order
    toxic, marks = np.array([r["toxic"] for r in design]), np.array([r["marks"] for r in design])
    grades = toxic.astype(np.int64) + (toxic & (marks >= np.median(marks[toxic])) & (marks > 0))
    w, t = solve([r["cols"] for r in design], grades, len(vocab))
    t = np.concatenate((t, np.full(2 - len(t), np.inf)))
    return Model({f: float(x) for f, x in zip(vocab, w)}, tuple(map(float, t)))


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, severity (expected grade, 0 to 2), p_toxic (P(grade >= 1))."""
    text_batches(docs.sparkSession)
    model_b = docs.sparkSession.sparkContext.broadcast(model)
    # a text that is kept goes to the workers once, inside the row
    own = [F.lit(0).alias("__text")] if text_col in keep else [F.col(f"`{text_col}`").alias("__text")]
    at = list(keep).index(text_col) if text_col in keep else None
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row"), *own)

    def run(batches):
        m, of = model_b.value, {}
        for b in batches:
            sev, tox = [], []
            for t in (b.column("__text") if at is None else b.column("__row").field(at)).to_pylist():
                found = set()
                for w in set(WORD.findall((t or "").lower())):
                    f = of.get(w)
                    if f is None:
                        if len(of) > 100_000:               # bounded memory of the worker's cache
                            of.clear()
                        f = of[w] = tuple(x for x in word_features(w) if x in m.weights)
                    if f:
                        found.update(f)
                p = m.probabilities(math.fsum(m.weights[f] for f in found))
                sev.append(sum(p))
                tox.append(p[0])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sev, pa.float64()), pa.array(tox, pa.float64())], ["__row", "__sev", "__tox"])

    out = d.mapInArrow(lean(run), T.StructType([d.schema["__row"], T.StructField("__sev", T.DoubleType()), T.StructField("__tox", T.DoubleType())]))
    return out.select(*[F.col(f"__row.`{c}`").alias(c) for c in keep], F.col("__sev").alias("severity"), F.col("__tox").alias("p_toxic"))


def reject(docs: DataFrame, labels: DataFrame, limit: float = 0.5, **kw) -> DataFrame:
    """The rows of ``docs`` that the model does not find toxic."""
    model = fit(docs, labels, **kw)
    text = kw.get("text_col", "text")
    # by position: the table may hold columns named like the scores
    numbered = docs.toDF(*[f"__c{i}" for i in range(len(docs.columns))])
    kept = score(numbered, model, f"__c{docs.columns.index(text)}", numbered.columns).where(F.col("p_toxic") < limit)
    return kept.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)])
