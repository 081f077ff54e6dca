"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Statistics are column expressions. Small boosted trees are fitted on a bounded sample of labelled rows, every
path of a tree becomes a conjunctive rule, a lasso logistic regression keeps few of them, and the kept
rules are compiled into one Spark column.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import staged

#: Labelled rows that the fit reads at most; their statistics, not their texts, reach the driver.
SAMPLE = 20_000
TREES, DEPTH, LEAF, CUTS = 24, 3, 30, 24


def statistics(text: str = "text") -> dict[str, Column]:
    """Named statistics of a text; null counts as empty, and every statistic is defined for empty texts."""
    t = F.coalesce(F.col(text), F.lit(""))
    chars = F.greatest(F.char_length(t), F.lit(1))
    words = F.expr("filter(split(__t, '[ \\\\t\\\\n\\\\x0B\\\\f\\\\r]+'), w -> w <> '')")
    without = lambda pattern: F.char_length(F.regexp_replace("__t", pattern, ""))
    size = F.greatest(F.size("__words"), F.lit(1))
    lines = F.expr("filter(split(__t, '\\n'), l -> l <> '')")
    return {
        "__t": t, "__words": words, "__lines": lines,
        "log_words": F.log1p(F.size("__words")),
        "word_length": without("[ \\n\\t]+") / size,
        "distinct_words": F.size(F.array_distinct("__words")) / size,
        "upper": (chars - without("\\p{Lu}+")) / chars,
        "symbols": (chars - without("[^\\p{L}\\p{N}\\s.,]+")) / chars,
        "digits": (chars - without("[0-9]+")) / chars,
        "stops": (chars - without("[.,]+")) / chars,
        "bars": (chars - without("[|]+")) / chars,
        "line_repeats": 1 - F.size(F.array_distinct("__lines")) / F.greatest(F.size("__lines"), F.lit(1)),
        "line_length": F.log1p(chars / F.greatest(F.size("__lines"), F.lit(1))),
        "repeats": 1 - F.char_length(F.regexp_replace("__t", r"(?<![^ \n])([^ \n]{1,40}) \1(?![^ \n])", "")) / chars,
    }


def with_statistics(docs: DataFrame, text: str = "text") -> tuple[DataFrame, list[str]]:
    columns = statistics(text)
    out = docs
    for name in ("__t", "__words", "__lines"):
        out = out.withColumn(name, columns.pop(name))
    return out.select(*docs.columns, *(c.cast("double").alias(f"__s_{n}") for n, c in columns.items())), list(columns)


@dataclass(frozen=True)
class Rule:
    """A conjunction: statistics within half-open bounds, ``(name, low, high)``: low <= value < high."""

    terms: tuple[tuple[str, float, float], ...]
    weight: float = 0.0

    def sql(self) -> str:
        parts = []
        for name, low, high in self.terms:
            if low > -np.inf:
                parts.append(f"__s_{name} >= {low!r}D")
            if high < np.inf:
                parts.append(f"__s_{name} < {high!r}D")
        return " and ".join(parts) or "true"

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, low, high in self.terms:
            v = x[:, names.index(name)]
            out &= (v >= low) & (v < high)
        return out


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        """The compiled rules: a column between 0 and 1 over the statistics."""
        terms = [f"if({r.sql()}, {r.weight!r}D, 0D)" for r in self.rules]
        total = " + ".join([f"{self.intercept!r}D", *terms])
        return F.expr(f"1D / (1D + exp(-({total})))")


def _paths(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, names: list[str],
           cuts: list[np.ndarray], terms: dict) -> tuple[list[Rule], list[Rule]]:
    """Grow one regression tree on gradients: the paths to all its nodes, and those to its leaves."""
    here = [Rule(tuple((n, lo, hi) for n, (lo, hi) in sorted(terms.items())))] if terms else []
    best, name, cut = 1e-6, None, None
    if depth and len(rows) >= 2 * LEAF:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for k in range(x.shape[1]):
            where = np.searchsorted(cuts[k], x[rows, k], "right")
            gs, hs, ns = (np.bincount(where, v, len(cuts[k]) + 1).cumsum()[:-1] for v in (g[rows], h[rows], np.ones(len(rows))))
            gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
            gain[(ns < LEAF) | (len(rows) - ns < LEAF)] = -1
            if len(gain) and gain.max() > best:
                best, name, cut = gain.max(), k, float(cuts[k][int(gain.argmax())])
    if name is None:
        return here, here
    low, high = terms.get(names[name], (-np.inf, np.inf))
    left = x[rows, name] < cut
    leaves: list[Rule] = []
    for side, bounds in ((left, (low, min(high, cut))), (~left, (max(low, cut), high))):
        nodes, ends = _paths(x, g, h, rows[side], depth - 1, names, cuts, terms | {names[name]: bounds})
        here, leaves = here + nodes, leaves + ends
    return here, leaves


def _lasso(design: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient steps."""
    n, m = design.shape
    lipschitz = 0.25 * np.linalg.norm(design, 2) ** 2 / n + 0.25 + 1e-9
    w = z = np.zeros(m)
    b = c = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ z + c, -30, 30)))
        g = design.T @ (p - y) / n
        step = z - g / lipschitz
        w_next = np.sign(step) * np.maximum(np.abs(step) - penalty / lipschitz, 0)
        b_next = c - (p - y).mean() / lipschitz
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, c = w_next + (t - 1) / t_next * (w_next - w), b_next + (t - 1) / t_next * (b_next - b)
        w, b, t = w_next, b_next, t_next
    return float(b), w


def fit(x: np.ndarray, y: np.ndarray, names: list[str], penalty: float = 0.002, seed: int = 5) -> Ensemble:
    """Rules from boosted trees on halves of the rows, weighted by lasso. Without both labels: a constant."""
    y = y.astype(float)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Ensemble(float(np.log(share / (1 - share))), ())
    x = np.nan_to_num(x)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, CUTS + 1)[1:-1])) for k in range(x.shape[1])]
    # quantiles alone miss thin tails, where junk lies
    cuts = [np.unique(np.concatenate((c, np.linspace(*np.quantile(x[:, k], (0.0, 1.0)), CUTS)[1:-1],
                                      np.quantile(x[:, k], (0.005, 0.01, 0.02, 0.98, 0.99, 0.995))))) for k, c in enumerate(cuts)]
    random, raw, rules = np.random.default_rng(seed), np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        rows = np.sort(random.permutation(len(y))[:max(2 * LEAF, len(y) // 2)])
        nodes, leaves = _paths(x, y - p, p * (1 - p), rows, DEPTH, names, cuts, {})
        rules += nodes
        for leaf in leaves:
            on = leaf.holds(x, names)
            raw[on] += 0.4 * (y - p)[on].sum() / ((p * (1 - p))[on].sum() + 1.0)
    rules = list(dict.fromkeys(rules))
    design = np.array([r.holds(x, names) for r in rules], np.float64).T
    spread = design.std(axis=0)
    keep = spread > 0
    rules, design, spread = [r for r, k in zip(rules, keep) if k], design[:, keep], spread[keep]
    if not rules:
        return Ensemble(float(raw[0]), ())
    b, w = _lasso(design / spread, y, penalty)
    w = w / spread
    return Ensemble(b, tuple(Rule(r.terms, float(v)) for r, v in zip(rules, w) if abs(v) > 1e-4))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, text: str = "text",
                key: str = "doc_id") -> Ensemble:
    """Fit on at most ``sample`` labelled rows, those whose id hashes lowest.

    ``labels`` must hold only the rows to learn from. Null labels, ids and texts without a label are left out.
    """
    marked = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(
        F.max(label).cast("double").alias("__y"))
    chosen = staged(marked.orderBy(F.xxhash64(key), key).limit(sample), "labelled")
    rows, names = with_statistics(docs.select(key, text).join(chosen, key), text)
    found = rows.select("__y", *(f"__s_{n}" for n in names)).orderBy(F.xxhash64(key), *(f"__s_{n}" for n in names)).limit(
        sample).toPandas().to_numpy(float)
    return fit(found[:, 1:], found[:, 0], names)


def with_quality(docs: DataFrame, model: Ensemble, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 by the compiled rules; one narrow stage."""
    rows, _ = with_statistics(docs, text)
    return rows.select(*docs.columns, model.score().alias(score))
