"""Quality classifier: a sparse rule ensemble over text statistics.

Small boosted trees are grown in numpy on a bounded sample of labelled texts; each path from a root is a
conjunctive rule over the statistics; a lasso logistic regression keeps and weighs few of the rules; those
compile into one Spark column expression, which scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidied
from .toxicity import fold

#: Most labelled rows that a model is fitted on.
MAX_LABELLED = 20000
FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.5
STATISTICS = (
    "log_bytes", "log_words", "upper", "digit", "symbol", "pipe", "bang", "stop", "comma", "non_ascii", "space",
    "word_bytes", "distinct_words", "distinct_pairs", "same_neighbour", "short_words", "long_words", "upper_words",
    "symbol_words", "distinct_lines", "line_words", "common_word",
)

_kinds = np.zeros((256, 9), np.float64)
for _column, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>@^~=+_{}[]\\", b"|", b"!?", b".", b",;:", bytes(range(128, 256)), b" \t\n\r\x0b\x0c")):
    _kinds[list(_bytes), _column] = 1
_symbols = b"#*$%&<>|"


def statistics_of(text: str | None) -> list[float]:
    """The statistics of a text, in the order of STATISTICS; all 0 for null and empty ones."""
    data = (text or "").encode()
    if not data:
        return [0.0] * len(STATISTICS)
    n = len(data)
    shares = (np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _kinds) / n
    words, lines = data.split(), [x for x in data.split(b"\n") if x]
    w, nl = max(1, len(words)), max(1, len(lines))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    distinct = set(words)
    return [
        np.log1p(n), np.log1p(len(words)), *shares.tolist(), float(sizes.mean()) if len(words) else 0.0, len(distinct) / w,
        len(set(zip(words, words[1:]))) / w, sum(map(bytes.__eq__, words, words[1:])) / w, float((sizes <= 3).mean()) if len(words) else 0.0,
        float((sizes >= 14).mean()) if len(words) else 0.0, sum(x.isupper() for x in words) / w,
        sum(x[-1] in _symbols for x in words) / w, len(set(lines)) / nl, min(500.0, len(words) / nl),
        float(max(np.bincount(np.unique(words, return_inverse=True)[1])) / w) if words and len(distinct) < w // 4 else 0.0,
    ]


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, every statistic as double) for every row of docs(doc_id, text)."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics_of(t) for t in batch.column(1).to_pylist()], np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(c)) for c in rows.T]], ["doc_id", *STATISTICS])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


#: A rule: conditions (number of the statistic, whether it is above, threshold), all of which must hold.
Condition = tuple[int, bool, float]
ConjunctiveRule = tuple[Condition, ...]


def _simplified(path: list[Condition]) -> ConjunctiveRule:
    """The tightest condition for each statistic and side."""
    kept: dict[tuple[int, bool], float] = {}
    for f, above, t in path:
        kept[f, above] = (max if above else min)(t, kept.get((f, above), t))
    return tuple(sorted((f, above, t) for (f, above), t in kept.items()))


def tree_rules(x: np.ndarray, y: np.ndarray, rounds: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 48, least: int = 10) -> list[ConjunctiveRule]:
    """The distinct root paths, inner ones included, of trees boosted on the logistic loss over binned statistics."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], 1)  # v > cut[k] iff bin > k
    z, rules = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), {}
    least = max(2, min(least, len(y) // 50))

    def grow(rows: np.ndarray, path: list[Condition], g: np.ndarray, h: np.ndarray) -> None:
        if path:
            rules[_simplified(path)] = None
        best, where, gs, hs = 1e-6, None, g[rows].sum(), h[rows].sum()
        if len(path) < depth and len(rows) >= 2 * least:
            for f, cut in enumerate(cuts):
                b = binned[rows, f]
                n, cg, ch = (np.cumsum(np.bincount(b, wt, len(cut) + 1))[:-1] for wt in (None, g[rows], h[rows]))
                ok = (n >= least) & (len(rows) - n >= least)
                gain = np.where(ok, cg**2 / (ch + 1) + (gs - cg) ** 2 / (hs - ch + 1) - gs**2 / (hs + 1), -1)
                if len(gain) and gain.max() > best:
                    best, where = gain.max(), (f, int(gain.argmax()))
        if where is None:
            z[rows] -= rate * gs / (hs + 1)
            return
        f, k = where
        above = binned[rows, f] > k
        grow(rows[~above], [*path, (f, False, float(cuts[f][k]))], g, h)
        grow(rows[above], [*path, (f, True, float(cuts[f][k]))], g, h)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        grow(np.arange(len(y)), [], p - y, p * (1 - p))
    return list(rules)


def holds(rule: ConjunctiveRule, x: np.ndarray) -> np.ndarray:
    return reduce(lambda a, c: a & ((x[:, c[0]] > c[2]) if c[1] else (x[:, c[0]] <= c[2])), rule, np.ones(len(x), bool))


def lasso_logistic(a: np.ndarray, y: np.ndarray, strength: float, steps: int = 300) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient; the intercept is not shrunk."""
    design = np.column_stack([a, np.ones(len(a))]).astype(np.float64)
    v = np.ones(design.shape[1])
    for _ in range(20):
        v = design.T @ (design @ v)
        norm = np.linalg.norm(v)
        v /= norm
    step = 4 * len(y) / norm
    w = u = np.zeros(design.shape[1])
    w[-1] = u[-1] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    t, shrink = 1.0, np.append(np.full(a.shape[1], strength * step), 0.0)
    for _ in range(steps):
        new = u - step * (design.T @ (1 / (1 + np.exp(-(design @ u))) - y)) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - shrink, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return float(w[-1]), w[:-1]


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[tuple[ConjunctiveRule, float], ...]

    def score(self) -> Column:
        """The ensemble over columns named as in STATISTICS."""

        def condition(c: Condition) -> Column:
            column = F.col(STATISTICS[c[0]])
            return column > c[2] if c[1] else column <= c[2]

        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            z = z + F.when(reduce(lambda a, b: a & b, map(condition, rule)), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def fit_rules(x: np.ndarray, y: np.ndarray, strength: float = 5e-4) -> RuleEnsemble:
    """One class or no rows: no rules, and the score is that class's share (0.5 without rows)."""
    share = float(y.mean()) if len(y) else 0.5
    if len(y) < 20 or share in (0.0, 1.0):
        p = min(0.999, max(0.001, share))
        return RuleEnsemble(float(np.log(p / (1 - p))), ())
    rules = tree_rules(x, y)
    intercept, weights = lasso_logistic(np.stack([holds(r, x) for r in rules], 1).astype(np.float32), y, strength)
    return RuleEnsemble(intercept, tuple((r, float(w)) for r, w in zip(rules, weights) if w))


def fitted(docs: DataFrame, labels: DataFrame) -> RuleEnsemble:
    """An ensemble from docs(doc_id, text) and labels(doc_id, quality), without the held-out fold.

    At most MAX_LABELLED ids, first by a hash of the id: the same data give the same ensemble. An id counts once, with
    its greatest label and text if rows repeat it. Labels other than 0 and 1 and null ids are not learnt from.
    """
    known = labels.filter((fold(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    chosen = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    # the limit bounds the broadcast, and one text for an id what comes to the driver
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.max("text").alias("text"))
    rows = statistics(texts).join(F.broadcast(chosen), "doc_id").toArrow()
    rows = rows.sort_by([(s, "ascending") for s in ("doc_id", *STATISTICS, "quality")])
    return fit_rules(np.stack([rows[s].to_numpy() for s in STATISTICS], 1), rows["quality"].to_numpy().astype(np.float64))


def scored(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text); other columns, whatever their names, are
    ignored. Null and empty texts score as texts without words. Repeated rows are scored each and alike, very long texts
    are taken whole, a null id is not held out. An empty table gives an empty one."""
    out = statistics(docs).withColumn("score", model.score())
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def kept(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """docs, with all columns, whatever their names, that the ensemble predicts to be of quality. One pass; text and scores
    travel together. What scored() says of odd rows holds here."""
    at = docs.columns.index("text")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics_of(t) for t in batch.column(at).to_pylist()], np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(np.ascontiguousarray(c)) for c in rows.T]], [*columns, *STATISTICS])

    columns = [f"_c{i}" for i in range(len(docs.columns))]
    fields = ", ".join(f"{c} {t.dataType.simpleString()}" for c, t in zip(columns, docs.schema)) + ", " + ", ".join(f"{s} double" for s in STATISTICS)
    good = docs.toDF(*columns).mapInArrow(run, fields).filter(model.score() >= THRESHOLD).select(*columns)
    return good.toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, fitted(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")))
