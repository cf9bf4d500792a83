"""Quality classifier: a sparse ensemble of rules.

Statistics of whole texts are Spark columns. Shallow boosted trees on a bounded sample give paths, each a conjunction of
thresholds; a lasso logistic fit keeps few of them; what is left is compiled into one Spark column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sample import labelled, remainder

#: Bound of the sample on which the model is fitted, for each of the two labels.
PER_CLASS = 6000
TREES, DEPTH, BINS, LEAST, RATE = 40, 3, 32, 10, 0.3
LASSO = 0.002

Rule = tuple[tuple[str, bool, float], ...]  # statistic, whether it is above, threshold


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs with a struct __s of doubles. Null texts count as empty; shares of nothing are 0; repeated rows are measured each by
    itself; an empty table gives an empty one; columns that begin with two underscores are ours and may be replaced."""
    text = F.coalesce(F.col("text"), F.lit(""))
    filled = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    df = docs.withColumns({"__words": filled, "__lines": lines, "__len": F.length(text), "__symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")), "__upper": F.regexp_count(text, F.lit("[A-Z]")), "__digits": F.regexp_count(text, F.lit("[0-9]")), "__marks": F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit(""))), "__chars": F.aggregate(filled, F.lit(0), lambda a, w: a + F.length(w))})
    n, m = F.size("__words"), F.size("__lines")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0)).cast("double")
    pairs = F.size(F.array_distinct(F.zip_with("__words", F.slice("__words", 2, F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b))))
    stats = {
        "words": n.cast("double"),
        "word_length": share(F.col("__chars"), n),
        "symbols": share(F.col("__symbols"), n),
        "capitals": share(F.col("__upper"), F.col("__len")),
        "digits": share(F.col("__digits"), F.col("__len")),
        "marks": share(F.col("__marks"), n),
        "distinct_words": share(F.size(F.array_distinct("__words")), n),
        "distinct_pairs": share(pairs, n),
        "distinct_lines": share(F.size(F.array_distinct("__lines")), m),
        "line_words": share(n, m),
    }
    return df.withColumn("__s", F.struct(*(c.alias(k) for k, c in stats.items()))).select(*docs.columns, "__s")


STATISTICS = ("words", "word_length", "symbols", "capitals", "digits", "marks", "distinct_words", "distinct_pairs", "distinct_lines", "line_words")


def paths(x: np.ndarray, y: np.ndarray, seed: int = 3) -> list[Rule]:
    """Conjunctions on the way to every node of boosted trees, each tree on half of the rows."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)  # above cut k: bin > k
    z, found = np.zeros(len(y)), {}

    def grow(at: np.ndarray, g: np.ndarray, h: np.ndarray, path: Rule, depth: int) -> None:
        best = (1e-6, None)
        total = g[at].sum() ** 2 / (h[at].sum() + 1)
        for j, c in enumerate(cuts) if depth < DEPTH and len(at) >= 2 * LEAST else ():
            size = len(c) + 1
            n, gs, hs = (np.cumsum(np.bincount(binned[at, j], w, size))[:-1] for w in (None, g[at], h[at]))
            ok = (n >= LEAST) & (len(at) - n >= LEAST)
            gain = np.where(ok, gs**2 / (hs + 1) + (g[at].sum() - gs) ** 2 / (h[at].sum() - hs + 1) - total, 0)
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), (j, int(gain.argmax())))
        if best[1] is None:
            value[at] = -RATE * g[at].sum() / (h[at].sum() + 1)
            return
        j, k = best[1]
        above = binned[at, j] > k
        for side in (False, True):
            way = (*path, (STATISTICS[j], side, float(cuts[j][k])))
            found.setdefault(tuple(sorted(way)))
            grow(at[above == side], g, h, way, depth + 1)

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        half = rng.random(len(y)) < 0.5
        value = np.zeros(len(y))
        g, h = np.where(half, p - y, 0.0), np.where(half, p * (1 - p), 0.0)
        grow(np.arange(len(y)), g, h, (), 0)
        z += value
    return list(found)


def holds(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    col = {k: x[:, j] for j, k in enumerate(STATISTICS)}
    return np.stack([np.logical_and.reduce([(col[k] > t) == up for k, up, t in r]) for r in rules], 1).astype(float) if rules else np.zeros((len(x), 0))


def lasso(a: np.ndarray, y: np.ndarray, strength: float = LASSO, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights with an L1 penalty by accelerated proximal gradient; the intercept is not penalised."""
    n, m = a.shape
    full = np.hstack([a, np.ones((n, 1))])
    v = np.ones(m + 1)
    for _ in range(30):
        v = full.T @ (full @ v)
        v /= np.linalg.norm(v)
    step = 4 * n / (np.linalg.norm(full @ v) ** 2 * 1.05 + 1e-12)
    w = u = np.zeros(m + 1)
    t = 1.0
    for _ in range(steps):
        grad = full.T @ (1 / (1 + np.exp(-np.clip(full @ u, -40, 40))) - y) / n
        new = u - step * grad
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * strength, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[:-1], float(w[-1])


@dataclass
class Model:
    rules: list[tuple[Rule, float]]
    bias: float

    def column(self) -> Column:
        """The score as one column over __s."""
        z = F.lit(self.bias)
        for rule, weight in self.rules:
            test = F.lit(True)
            for name, up, at in rule:
                s = F.col(f"__s.{name}")
                test = test & ((s > at) if up else (s <= at))
            z = z + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Rows come in a fixed order, so reruns agree. Without both labels: the label there is (0.5 for no rows)."""
    if len(set(y.tolist())) < 2:
        return Model([], 0.0 if not len(y) else 20.0 if y[0] == 1 else -20.0)
    rules = paths(x, y)
    a = holds(rules, x)
    weights, bias = lasso(a, y)
    return Model([(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6], bias)


def fit(docs: DataFrame, labels: DataFrame, fold_mod: int = 3, held_out: int = 1, per_class: int = PER_CLASS) -> Model:
    """The model of a bounded sample of labelled rows of the folds that are not held out: at most per_class rows of each label,
    those with the least hashes of doc_id, whose statistics (not texts) go to the driver. Null and empty texts count as texts
    without words; labels other than 0 and 1, null ids and ids without a document are left out; repeated rows count again; no
    rows of one label give the other's score. Only doc_id, text and quality are read."""
    fold = remainder(F.col("__id"), fold_mod) != held_out
    rows = with_statistics(labelled(docs.select("doc_id", "text"), labels, "quality", fold, per_class))
    rows = rows.select("doc_id", "y", "__s.*").toPandas().sort_values(["doc_id", "y", *STATISTICS])
    return train(rows[list(STATISTICS)].to_numpy(float), rows["y"].to_numpy(float))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1) and predicted. Null texts count as empty and score like any other; rows are scored one by
    one; an empty table gives an empty one; columns named score and predicted are replaced."""
    docs = docs.drop("score", "predicted")
    out = with_statistics(docs).withColumn("score", model.column())
    return out.select(*docs.columns, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
