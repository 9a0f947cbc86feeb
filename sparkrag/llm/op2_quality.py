"""Quality classifier: a sparse rule ensemble.

Boosted trees of depth DEPTH over text statistics are cut into rules (the conjunction of conditions on each path), a
logistic model with lasso weights picks among the rules, and the picked ones compile into one Spark column. Training
uses at most SAMPLE labelled rows, those of least (crc32 of doc_id, doc_id), also where ids repeat; statistics and scores
cover all rows.
Null and empty texts have statistics of zero and are scored as such; rows without label are scored only, null labels
are not learnt from; with labels of one kind, or none, every score is the share of label 1 (0.5 without labels);
repeated rows get equal scores; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table, words

SAMPLE = 20000
DEPTH, TREES, BINS, RATE = 3, 30, 24, 0.3
LASSO = 0.002
FOLDS = 5
THRESHOLD = 0.3
FEATURES = ("n_words", "word_length", "symbols", "exclaims", "bars", "upper", "digits", "distinct", "dup_lines", "line_words", "stops")


def statistics(text: Column) -> Column:
    """Struct of doubles, one per name of FEATURES."""
    text = F.coalesce(text, F.lit(""))
    lacks = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))).cast("double")
    chars = F.greatest(F.length(text), F.lit(1))

    def of(w: Column, x: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1)).cast("double")
        lines = F.greatest(F.size(x), F.lit(1)).cast("double")
        values = (
            F.size(w).cast("double"), F.length(F.translate(text, " \t\n\x0b\x0c\r", "")) / n, lacks("#*$%&<>") / n, lacks("!") / n, lacks("|") / n,
            lacks("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / chars, lacks("0123456789") / chars, F.size(F.array_distinct(w)) / n,
            (F.size(x) - F.size(F.array_distinct(x))) / lines, n / lines, lacks(".") / n,
        )
        return F.struct(*[F.round(v, 6).alias(name) for v, name in zip(values, FEATURES)])

    return let(words(text), lambda w: let(F.split(text, "\n", -1), lambda x: of(w, x)))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, *FEATURES) of docs (doc_id, text)."""
    return docs.select("doc_id", statistics(F.col("text")).alias("_s")).select("doc_id", "_s.*")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


Rule = tuple[tuple[int, float, bool], ...]


def grow(x: np.ndarray, y: np.ndarray) -> set[Rule]:
    """Paths (feature, cut, above) of boosted regression trees on the logistic loss."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, BINS))) for f in range(x.shape[1])]
    above = np.concatenate([x[:, f, None] > c for f, c in enumerate(cuts)], axis=1)
    names = [(f, float(c)) for f, cs in enumerate(cuts) for c in cs]
    raw, out = np.zeros(len(y)), set()

    def split(rows: np.ndarray, path: Rule, g: np.ndarray, h: np.ndarray) -> None:
        if path:
            out.add(tuple(sorted(path)))
        if len(path) < DEPTH and len(rows) >= 10:
            side = above[rows]
            gr, hr = g[rows] @ side, h[rows] @ side
            gs, hs = g[rows].sum(), h[rows].sum()
            gain = gr**2 / (hr + 1) + (gs - gr) ** 2 / (hs - hr + 1) - gs**2 / (hs + 1)
            gain[(side.sum(0) < 4) | (side.sum(0) > len(rows) - 4)] = 0
            best = int(np.argmax(gain))
            if gain[best] > 1e-3:
                for up in (False, True):
                    split(rows[side[:, best] == up], (*path, (*names[best], up)), g, h)
                return
        raw[rows] += RATE * g[rows].sum() / (h[rows].sum() + 1)

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        split(np.arange(len(y)), (), y - p, p * (1 - p))
    return out


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[float, Rule]]]:
    """Intercept and weighted rules."""
    if len(y) == 0:
        return 0.0, []
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(rate / (1 - rate)))
    rules = sorted(grow(x, y)) if 0 < y.mean() < 1 else []
    if not rules:
        return base, []
    z = np.array([np.logical_and.reduce([(x[:, f] > c) == up for f, c, up in r]) for r in rules], float).T
    b, w, step = base, np.zeros(len(rules)), 4 * len(y) / (np.linalg.norm(z, 2) ** 2 + len(y))
    vb, vw, t = b, w.copy(), 1.0
    for _ in range(2000):
        e = (1 / (1 + np.exp(-(vb + z @ vw))) - y) / len(y)
        nb, nw = vb - step * e.sum(), vw - step * (z.T @ e)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * LASSO, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vb, vw = nb + (t - 1) / t2 * (nb - b), nw + (t - 1) / t2 * (nw - w)
        b, w, t = nb, nw, t2
    return float(b), [(float(a), r) for a, r in zip(w, rules) if abs(a) > 1e-4]


def compiled(model: tuple[float, list[tuple[float, Rule]]]) -> Column:
    """The score of a row with columns FEATURES."""
    raw = F.lit(model[0])
    for weight, rule in model[1]:
        hit = F.lit(True)
        for f, cut, up in rule:
            hit = hit & ((F.col(FEATURES[f]) > cut) if up else (F.col(FEATURES[f]) <= cut))
        raw = raw + F.when(hit, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-raw))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "quality")
    some = known.orderBy(fold, "doc_id", "quality").limit(sample)
    # The sample has at most `sample` rows, so it may be broadcast.
    rows = measured(docs.select("doc_id", "text").join(F.broadcast(some.select("doc_id").distinct()), "doc_id"))
    # Repeated ids multiply in the join, so the bound holds for what comes out of it.
    data = rows.join(F.broadcast(some), "doc_id").orderBy(fold, "doc_id", "quality", *FEATURES).limit(sample).toPandas()
    return fit(data[list(FEATURES)].to_numpy(float), data["quality"].to_numpy(float))


def score(docs: DataFrame, model) -> DataFrame:
    value = compiled(model)
    return measured(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), value.alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
