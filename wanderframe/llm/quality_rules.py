"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule rejects a document by a predicate over its text. The cascade measures, on a bounded sample,
how often each rule rejects and what it costs a row, orders the rules by rejections per cost, and evaluates
them as one nested CASE, so that a document rejected early never pays for the later rules. The order
changes the cost, never the verdict.
"""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_RUN, let, split_words, steps, table

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
#: Rows, expected, that costs and selectivities are estimated on, and passes over them, of which the fastest counts.
SAMPLE_ROWS, PASSES = 1000, 3

log = logging.getLogger(__name__)


def symbol_count(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))


def duplicate_line_count(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, SPACE_RUN, "")) > 0)
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def repeated_word_count(words: Column, window: int = WINDOW) -> Column:
    """Words inside a window of consecutive words that the text holds twice or more.

    Windows are compared by a 64-bit hash. Sorting (hash, position) brings equal windows together; the
    covered positions are the union of the intervals that start at them. Linearithmic in the text.
    """

    def covered(pairs: Column) -> Column:
        ordered = F.sort_array(pairs)
        twins = let(ordered, lambda s: F.filter(s, lambda x, i: (
            F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))))
        starts = F.sort_array(F.transform(twins, lambda x: x["p"]))
        return let(starts, lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window)))),
            F.lit(0), lambda a, x: a + x))

    def counted(ws: Column) -> Column:
        hashes = F.transform(steps(F.size(ws) - (window - 1)), lambda i: F.xxhash64(F.slice(ws, i, window)))
        return let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(
            covered(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))))

    return let(words, counted)


def text_statistics(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long); null text counts as empty, empty and
    blank ones have no words and no lines, very long ones are taken whole."""
    text = F.coalesce(text, F.lit(""))
    return let(split_words(text), lambda ws: F.struct(
        F.size(ws).cast("long").alias("n_words"),
        F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
        symbol_count(text).cast("long").alias("n_symbols"),
        duplicate_line_count(text).cast("long").alias("n_dup_lines"),
        repeated_word_count(ws).cast("long").alias("n_repeat_words")))


@dataclass(frozen=True)
class Rule:
    """rejects: a predicate over the columns of the DataFrame; a null verdict does not reject."""

    name: str
    rejects: Column


@dataclass(frozen=True)
class RuleEstimate:
    """rejected: share of the sample's rows; seconds: for a row."""

    rule: Rule
    rejected: float
    seconds: float

    @property
    def rejections_per_second(self) -> float:
        return self.rejected / max(self.seconds, 1e-9)


def measured(df: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[RuleEstimate]:
    """The rules with their rejection rate and cost on a random sample of the rows, best rejection per cost first.

    Rows are drawn from the scan, before anything is computed of them, and put into one partition, so that a pass is
    the work of one core and not the start of many tasks. A rule's cost is the fastest of its passes less the fastest
    of empty ones. df is read once for its number of rows and once for the sample.
    """
    rows = df.count()
    sample = df.sample(min(1.0, sample_rows / max(1, rows)), seed=17).repartition(1).cache()
    try:
        drawn = max(1, sample.count())

        def fastest(predicate: Column) -> tuple[int, float]:
            found = []
            for _ in range(PASSES):
                began = time.perf_counter()
                hits = sample.agg(F.sum(F.coalesce(predicate, F.lit(False)).cast("int"))).first()[0] or 0
                found.append(time.perf_counter() - began)
            return hits, min(found)

        empty = F.length(F.col(next(c for c, t in df.dtypes if t == "string"))) < 0 if any(t == "string" for _, t in df.dtypes) else F.lit(False)
        fastest(empty)
        base = fastest(empty)[1]
        found = []
        for rule in rules:
            hits, seconds = fastest(rule.rejects)
            found.append(RuleEstimate(rule, hits / drawn, max(0.0, seconds - base) / drawn))
    finally:
        sample.unpersist()
    found.sort(key=lambda e: (-e.rejections_per_second, e.seconds, e.rule.name))
    log.info("rules in order, with rejected share and microseconds a row: %s", ", ".join(f"{e.rule.name} {e.rejected:.4f} {e.seconds * 1e6:.1f}" for e in found))
    return found


def rejecting_rule(rules: list[Rule]) -> Column:
    """Name of the first rule in this order that rejects the row; null where none does. Later ones are not evaluated."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(rule.name)).otherwise(out)
    return out


def cascade(df: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS, into: str = "rejected_by") -> DataFrame:
    """df with a column that names the rejecting rule or is null. All rows and columns stay; a column of df named like
    into is an error, as the result would hide it.

    An empty table or sample has no estimates and takes the rules by name, as ties in the estimates do. Null and empty
    texts have no words; very long ones are taken whole; repeated rows are judged each.
    """
    if into in df.columns:
        raise ValueError(f"there is a column {into} already: name another with into")
    ordered = [e.rule for e in measured(df, rules, sample_rows)]
    return df.withColumn(into, rejecting_rule(ordered))


def base_rules(text: Column) -> list[Rule]:
    """Few words; many repeated windows."""
    words = split_words(F.coalesce(text, F.lit("")))
    return [
        Rule("few_words", F.size(words) < 10),
        Rule("repeated_windows", let(words, lambda ws: F.lit(100) * repeated_word_count(ws) > F.lit(20) * F.size(ws))),
    ]


def further_rules(text: Column) -> list[Rule]:
    """Many symbols; many repeated lines; words that are very short or long in the mean. Over raw text: each computes no
    more than it needs, and splits nothing where a text without symbols or line ends decides."""
    text = F.coalesce(text, F.lit(""))
    words = split_words(text)
    line_ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return [
        Rule("symbols", let(symbol_count(text), lambda n: (n > 0) & (10 * n > F.length(F.array_join(words, ""))))),
        Rule("duplicate_lines", (line_ends > 0) & (2 * duplicate_line_count(text) > F.size(words))),
        Rule("word_length", let(words, lambda ws: (F.size(ws) > 0) & (
            (F.length(F.array_join(ws, "")) < 2 * F.size(ws)) | (F.length(F.array_join(ws, "")) > 20 * F.size(ws))))),
    ]


def text_rules(text: Column) -> list[Rule]:
    """The production rules, over raw text."""
    return [*base_rules(text), *further_rules(text)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: base statistics and verdict for every document. Null and empty texts have no words and fail.

    The statistics are asked for of every document. The further rules run on the texts of those that have not failed by
    them, in the order of their measured rejections per cost, until one rejects.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ordered = [e.rule for e in measured(docs, further_rules(F.col("text")))]
    counted = docs.select("doc_id", "text", text_statistics(F.col("text")).alias("s")).select("doc_id", "text", "s.*")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = counted.withColumn("base_failed", failed)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(F.col("base_failed"), F.lit(False)).otherwise(rejecting_rule(ordered).isNull()).alias("kept"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT r, i, array_to_string(list_slice(ws, i, i + 4), ' ') AS g
        FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
twin AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, sum(least(5, coalesce(nxt - i, 5))) AS n FROM
        (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twin) GROUP BY r),
ln AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM d)
       WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
s AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(ln.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN rep USING (r) LEFT JOIN ln USING (r))
SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > word_chars
            OR 2 * n_dup_lines > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM s
"""
