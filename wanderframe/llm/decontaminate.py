"""Benchmark decontamination in DataFrame functions only.

The benchmark's word windows are hashed; the set of hashes is broadcast after its size has been counted (above the
bound slim rows of text key, place and hash shuffle instead). Every window of every document is looked up, the texts
with a hit are fetched again, hits are verified word by word, and the words that a hit window covers are counted. What
a document gets depends on its text alone, so results are kept by 128 bits of the text: copies are computed together
and joined back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, let, light, split_words, steps, table, written

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The same with A-Z as word characters, for texts that are not lower-cased, and its complement.
ANY_CASE_SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
ANY_CASE_WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
WINDOW = 13
#: A document is contaminated from one hit word in so many on.
ONE_IN = 20
#: Largest set of hashes that is broadcast, at HASH_BYTES each.
BROADCAST_BYTES, HASH_BYTES = 64 << 20, 32


def words_of(text: Column) -> Column:
    return split_words(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS)


def text_key(text: Column) -> Column:
    """128 bits that stand for a text."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(text).alias("one"), F.xxhash64(F.lit(29), text).alias("two"))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, k, h, w, id): each window of k words of each item, its hash and 128 bits that stand for it.

    An item of fewer words than a window is one window. Items without words, and those with a null id, have none.
    """
    items = benchmark.filter("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("ws"))
    k = F.least(F.lit(window), F.size("ws"))
    found = items.filter(F.size("ws") > 0).select("item", k.alias("k"), F.explode(F.transform(
        F.sequence(F.lit(1), F.size("ws") - k + 1), lambda i: F.slice("ws", i, F.least(F.lit(window), F.size("ws"))))).alias("w"))
    return found.select("item", "k", F.xxhash64("w").alias("h"), "w", F.struct(F.xxhash64("w", "k").alias("one"), F.xxhash64(F.lit(31), "w").alias("two")).alias("id")).distinct()


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, hit_words, items): for the text_key of each text with a hit, its hit words (numbers from 1) and the items
    whose windows occur in it, both sorted. docs(text)."""
    owned = written(item_windows(benchmark, window), "item-windows")
    known = written(owned.select("h", "k", "w", "id").dropDuplicates(["id"]), "known-windows")
    hashes = known.select("h", "k").distinct()
    lengths, many = known.agg(F.sort_array(F.collect_set("k")), F.count(F.lit(1))).first()
    if many * HASH_BYTES <= BROADCAST_BYTES:
        hashes = F.broadcast(hashes)
    texts = docs.select(text_key(F.col("text")).alias("key"), "text")

    def of_length(ws: Column, k: int) -> Column:
        return F.transform(steps(F.size(ws) - (k - 1)), lambda i: F.struct(i.alias("p"), F.lit(k).alias("k"), F.xxhash64(F.slice(ws, i, k)).alias("h")))

    nothing = F.array().cast("array<struct<p:int,k:int,h:bigint>>")
    windows = let(words_of(F.col("text")), lambda ws: reduce(F.concat, [of_length(ws, k) for k in lengths])) if lengths else nothing
    exploded = texts.select("key", F.explode(windows).alias("x")).select("key", "x.p", "x.k", "x.h")
    # copies of a text give the same rows: once each
    met = written(exploded.join(hashes, ["h", "k"], "left_semi").distinct(), "window-hits")
    # any of a text's copies will do, as the key stands for the text
    again = texts.join(light(written(met.select("key").distinct(), "hit-texts"), 64, BROADCAST_BYTES), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")).select("key", words_of(F.col("text")).alias("ws"))
    by_hash = met.join(known, ["h", "k"]).groupBy("key").agg(F.collect_list(F.struct("p", "k", "w", "id")).alias("maybe"))
    true = again.join(by_hash, "key").select("key", F.filter("maybe", lambda x: F.slice("ws", x["p"], x["k"]) == x["w"]).alias("true")).filter(F.size("true") > 0)
    sure = written(true.select("key", F.transform("true", lambda x: F.struct(x["p"].alias("p"), x["k"].alias("k"), x["id"].alias("id"))).alias("true")), "verified-hits")
    covered = F.array_distinct(F.flatten(F.transform("true", lambda x: F.sequence(x["p"], x["p"] + x["k"] - 1))))
    found = sure.select("key", F.explode(F.array_distinct(F.transform("true", lambda x: x["id"]))).alias("id")).join(owned.select("id", "item"), "id").select("key", "item").distinct()
    return sure.select("key", F.sort_array(covered).alias("hit_words")).join(found.groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items")), "key")


def _apart(docs: DataFrame) -> tuple[DataFrame, Column]:
    """docs under column names that no other name here equals, with the key of its text, and the column that holds it."""
    plain = docs.toDF(*[f"column {i}" for i in range(len(docs.columns))])
    text = F.col(f"`column {docs.columns.index('text')}`")
    return plain.withColumn("key", text_key(text)), text


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated) for every row of docs(doc_id, text); other columns, whatever
    their names, are ignored.

    Null and empty texts have no words and no hits. Repeated rows are judged each. An empty benchmark hits nothing, an
    empty table gives an empty one. Very long texts are taken whole. Items are sorted as strings; ids that several items
    share count once.
    """
    docs = docs.select("doc_id", "text")
    found = written(hits(docs, benchmark, window), "benchmark-hits")
    n_words = F.size(split_words(F.col("text"), ANY_CASE_SEPARATORS)).cast("long")
    rows = docs.select("doc_id", n_words.alias("n_words"), text_key(F.col("text")).alias("key"))
    n_hit = F.coalesce(F.size("hit_words"), F.lit(0)).cast("long")
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return rows.join(found, "key", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"),
        ((n_hit > 0) & (ONE_IN * n_hit >= F.col("n_words"))).alias("contaminated"))


def without_words(text: Column, numbers: Column) -> Column:
    """text less the words with these numbers (from 1, sorted); what stands between words stays. Linear in the text."""
    parts = F.regexp_extract_all(text, F.lit(f"{ANY_CASE_WORD}|{ANY_CASE_SEPARATORS}"), F.lit(0))
    first = F.when(text.rlike(f"^{ANY_CASE_WORD}"), F.lit(0)).otherwise(F.lit(1))
    # for each word up to the last hit one whether it is hit
    gone = F.flatten(F.transform(numbers, lambda x, i: F.concat(F.array_repeat(F.lit(False), x - F.coalesce(F.get(numbers, i - 1), F.lit(0)) - 1), F.array(F.lit(True)))))
    return let(gone, lambda g: F.array_join(F.filter(parts, lambda x, i: ~(
        (F.pmod(i + first, F.lit(2)) == 0) & F.coalesce(F.get(g, F.floor((i - first) / 2).cast("int")), F.lit(False)))), ""))


def decontaminated(docs: DataFrame, benchmark: DataFrame, action: str = "documents", window: int = WINDOW) -> DataFrame:
    """docs, with all columns, whatever their names, less the contaminated documents (action documents) or the hit words
    (action spans). Null texts, which have no words, stay; what overlaps() says of odd rows holds here."""
    if action not in ("documents", "spans"):
        raise ValueError(action)
    found = hits(docs.select("text"), benchmark, window)
    keyed, text = _apart(docs)
    if action == "spans":
        both = keyed.join(written(found.select("key", "hit_words"), "benchmark-hits"), "key", "left")
        clean = F.when(F.col("hit_words").isNull(), text).otherwise(without_words(text, F.col("hit_words")))
        return both.select(*[(clean if c == "text" else F.col(f"`column {i}`")).alias(c) for i, c in enumerate(docs.columns)])
    n_words = F.size(split_words(text, ANY_CASE_SEPARATORS))
    counts = written(found.select("key", F.size("hit_words").alias("n_hit")), "benchmark-hits")
    both = keyed.join(light(counts, 64, BROADCAST_BYTES), "key", "left")
    return both.filter(F.col("n_hit").isNull() | (ONE_IN * F.col("n_hit") < n_words)).select(*[F.col(f"`column {i}`").alias(c) for i, c in enumerate(docs.columns)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = overlaps(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH low AS (SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, ws, least(13, len(ws)) AS k FROM (SELECT item_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
        FROM benchmark WHERE item_id IS NOT NULL) WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS g FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM b)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, k, i, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS g FROM (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM low, ks WHERE len(ws) >= k)),
m AS (SELECT r, dw.k AS k, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM m) GROUP BY r),
it AS (SELECT r, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM m) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
       sha256(coalesce(it.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(ws) AS contaminated
FROM low LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
