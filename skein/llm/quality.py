"""Quality classifier: a sparse rule ensemble over text statistics, compiled into Spark columns.

Shallow trees on resampled rows give conjunctive rules (one for each path from the root); a logistic model with an L1
penalty keeps few of them; the rest is a sum of weighted conditions that Spark evaluates beside the statistics, so
scoring is one narrow pass over the texts.

The fit reads at most MAX_TRAIN labelled rows (those with the least hash of the key, so the same at every run), of which
each tree draws at most TREE_ROWS. Defined results: a null text counts as empty and has a score like any other; labels that
are null, or belong to no document, are not learned from; without labels, or with one class only, every score is that
class's share (1.0 without any label); documents with the same statistics have the same score; repeated rows keep their
own result; an empty table gives no rows; further columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import unused

#: Labelled rows that a fit reads at most.
MAX_TRAIN = 20_000
TREE_ROWS = 8_000
N_TREES = 40
DEPTH = 3
BINS = 32
MIN_LEAF = 15
PENALTY = 0.002
STEPS = 400


def statistics(text: Column, name: Callable[[str], str]) -> tuple[dict[str, Column], dict[str, Column]]:
    """Two layers of columns: intermediate ones (arrays, counts) and the statistics made of them; name makes their names."""
    body = F.coalesce(text, F.lit(""))
    count = lambda keep: F.length(F.regexp_replace(body, f"[^{keep}]+", ""))
    base = {
        "length": F.length(body),
        "words": F.filter(F.split(body, r"\s+"), lambda w: w != ""),
        "lines": F.filter(F.split(body, "\n"), lambda w: w != ""),
        "capitals": count(r"\p{Lu}"), "digits": count("0-9"), "symbols": count(r"#$%&*|=_~^<>{}\[\]\\@+/"), "bangs": count("!?"), "marks": count(".,;:"),
    }
    of = lambda k: F.col(f"`{name(k)}`")
    n, k = F.greatest(of("length"), F.lit(1)), F.greatest(F.size(of("words")), F.lit(1))
    lines = F.greatest(F.size(of("lines")), F.lit(1))
    out = {
        "n_chars": of("length").cast("double"),
        "n_words": F.size(of("words")).cast("double"),
        "word_length": of("length") / k,
        "distinct_words": F.size(F.array_distinct(of("words"))) / k,
        "line_words": k / lines,
        "distinct_lines": F.size(F.array_distinct(of("lines"))) / lines,
        "upper": of("capitals") / n, "digit": of("digits") / n, "symbol": of("symbols") / n, "bang": of("bangs") / n, "stops": of("marks") / n,
        "bang_words": of("bangs") / k, "symbol_words": of("symbols") / k, "stop_words": of("marks") / k,
    }
    return {name(k): c for k, c in base.items()}, {name(k): c for k, c in out.items()}


NAMES = [
    "n_chars", "n_words", "word_length", "distinct_words", "line_words", "distinct_lines", "upper", "digit", "symbol", "bang", "stops", "bang_words", "symbol_words", "stop_words",
]


@dataclass(frozen=True)
class Rules:
    """score = 1 / (1 + exp(-(bias + sum of the weights whose conditions all hold)));
    a condition is (statistic, whether above, threshold)."""

    bias: float
    rules: tuple[tuple[float, tuple[tuple[str, bool, float], ...]], ...]

    def column(self, name: Callable[[str], str] = str) -> Column:
        """The score over the columns that name makes of the statistics' names."""
        z = F.lit(self.bias)
        for weight, conditions in self.rules:
            holds = None
            for x, above, cut in conditions:
                c = F.col(f"`{name(x)}`") > F.lit(cut) if above else F.col(f"`{name(x)}`") <= F.lit(cut)
                holds = c if holds is None else holds & c
            z = z + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _grow(codes: np.ndarray, y: np.ndarray, rows: np.ndarray, features: np.ndarray, path: tuple, out: set, depth: int) -> None:
    """Adds to out the path of every node below this one; a step is (feature, whether above, bin)."""
    if depth == 0 or len(rows) < 2 * MIN_LEAF:
        return
    total, ones = len(rows), y[rows].sum()
    if ones in (0, total):
        return
    gini = lambda p, m: 2 * p * (m - p) / np.maximum(m, 1)
    best = (gini(ones, total) - 1e-9, -1, -1)
    for f in features:
        m = np.cumsum(np.bincount(codes[rows, f], minlength=BINS))[:-1]
        p = np.cumsum(np.bincount(codes[rows, f], weights=y[rows], minlength=BINS))[:-1]
        cost = gini(p, m) + gini(ones - p, total - m)
        cost[(m < MIN_LEAF) | (total - m < MIN_LEAF)] = np.inf
        b = int(np.argmin(cost))
        if cost[b] < best[0]:
            best = (cost[b], int(f), b)
    _, f, b = best
    if f < 0:
        return
    high = codes[rows, f] > b
    for above, side in ((False, rows[~high]), (True, rows[high])):
        step = (*path, (f, above, b))
        out.add(tuple(sorted(step)))
        _grow(codes, y, side, features, step, out, depth - 1)


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str] = NAMES, seed: int = 7) -> Rules:
    """Trees, their paths as rules, L1 logistic weights by accelerated proximal steps."""
    if not len(y):
        return Rules(40.0, ())
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    base = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return Rules(40.0 if y[0] else -40.0, ())
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    rng, paths = np.random.default_rng(seed), set()
    for _ in range(N_TREES):
        rows = rng.choice(len(y), min(len(y), TREE_ROWS), replace=True)
        _grow(codes, y, rows, rng.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False), (), paths, DEPTH)
    paths = sorted(p for p in paths if all(b < len(cuts[f]) for f, _, b in p))
    if not paths:
        return Rules(base, ())
    hold = np.empty((len(y), len(paths)), np.float32)
    for j, p in enumerate(paths):
        ok = np.ones(len(y), bool)
        for f, above, b in p:
            ok &= (codes[:, f] > b) == above
        hold[:, j] = ok
    mean, spread = hold.mean(0), np.maximum(hold.std(0), 0.02)
    z = (hold - mean) / spread
    step = 4 * len(y) / (np.linalg.norm(z, 2) ** 2 if z.shape[1] < 64 else _top(z) ** 2)
    w = v = np.zeros(len(paths))
    b0, t = base, 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(z @ v + b0, -30, 30)))
        new = v - step * (z.T @ (p - y)) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * PENALTY, 0)
        b0 -= 2 * float((p - y).mean())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    kept = np.flatnonzero(np.abs(w) > 1e-4)
    weight = w / spread
    rules = tuple((float(weight[j]), tuple((names[f], above, float(cuts[f][b])) for f, above, b in paths[j])) for j in kept)
    return Rules(float(b0 - (weight * mean)[kept].sum()), rules)


def _top(z: np.ndarray) -> float:
    v = np.ones(z.shape[1]) / np.sqrt(z.shape[1])
    for _ in range(30):
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v)
    return 1.02 * float(np.linalg.norm(z @ v))


def _names(docs: DataFrame) -> Callable[[str], str]:
    """Names with a beginning that no column of docs has."""
    mark = "stat_"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    return lambda x: mark + x


def with_statistics(docs: DataFrame, text: str, name: Callable[[str], str]) -> DataFrame:
    base, out = statistics(F.col(f"`{text}`"), name)
    return docs.withColumns(base).withColumns(out).drop(*base)


def training_rows(labels: DataFrame, label: str, folds: int, held: int) -> DataFrame:
    """At most MAX_TRAIN labelled keys outside the held-out fold."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(f"y is not null and doc_id is not null and crc32(cast(doc_id as string)) % {folds} != {held}")
    return known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(MAX_TRAIN)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> Rules:
    """Learns from the documents whose labels lie outside the held-out fold."""
    known = training_rows(labels, "quality", folds, held)
    # at most MAX_TRAIN rows of two integers
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    name = _names(rows)
    got = with_statistics(rows, "text", name).select("doc_id", "y", *map(name, NAMES)).toPandas().sort_values(["doc_id", "y"])
    return fit_rules(got[list(map(name, NAMES))].to_numpy(float), got["y"].to_numpy(float))


def score(docs: DataFrame, model: Rules, text: str = "text", name: str = "score") -> DataFrame:
    """docs with a further column name, the score."""
    if name.lower() in map(str.lower, docs.columns):
        raise ValueError(f"the column {name} is there already")
    own = _names(docs)
    return with_statistics(docs, text, own).withColumn(name, model.column(own)).drop(*map(own, NAMES))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose score reaches least, columns unchanged."""
    (name,) = unused(docs, "quality")
    return score(docs, fit(docs, labels), name=name).filter(F.col(name) >= least).drop(name)


def report(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    model = fit(docs, labels, folds, held)
    out = score(docs.select("doc_id", "text"), model)
    fold = F.crc32(F.col("doc_id").cast("string")) % folds == held
    return out.select("doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
