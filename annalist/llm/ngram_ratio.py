"""Quality rules: text statistics and a hashed n-gram log-likelihood ratio, in DataFrame functions.

Words and word pairs are hashed into a fixed number of buckets. One multinomial over buckets is
counted from trusted documents, one from all documents; a document's score is the mean over its
n-grams of the log ratio of the two, and documents below a fixed threshold are not kept.

Defined cases: null text has no words, scores 0 and fails the base rules; equal rows get equal
results; a document id that is null or unlabelled counts as not trusted; with no trusted
document all ratios come from smoothing alone; other columns are left out.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, functions as F

from annalist.llm import common

BUCKETS = 1 << 16
SMOOTHING = 1.0
THRESHOLD = -0.25
WINDOW = 8
# Ids of trusted documents are sent to all executors up to this number, else joined by shuffle.
MOST_TRUSTED = 2_000_000


def _word_hashes(docs: DataFrame) -> DataFrame:
    """doc_id, text and the words with the hashes of words and of word pairs."""
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), common.WORD_BREAK), "")
    df = docs.withColumn("_words", words)
    df = df.withColumn("_h1", F.transform("_words", lambda w: F.xxhash64(w)))
    return df.withColumn("_h2", _steps("_h1", 1))


def _steps(name: str, apart: int) -> Column:
    """Hashes of each element with the one ``apart`` places later."""
    keep = F.size(name) - apart
    ends = F.when(keep > 0, F.sequence(F.lit(0), keep - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(ends, lambda i: F.xxhash64(F.get(name, i), F.get(name, i + apart)))


def _buckets(buckets: int) -> Column:
    """Buckets of the words and pairs of a document."""
    return F.transform(F.concat("_h1", "_h2"), lambda h: F.pmod(h, F.lit(buckets)).cast("int"))


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> list[float]:
    """log(target / raw) of each bucket: as many numbers as buckets, whatever the corpus."""
    ids = trusted.select("doc_id").where("doc_id IS NOT NULL").distinct().withColumn("_trusted", F.lit(1))
    ids = common.by_size(docs.sparkSession, ids, MOST_TRUSTED)
    # Documents are marked before their n-grams are taken apart: what is joined are documents.
    marked = common.text_column(docs).join(ids, "doc_id", "left")
    grams = _word_hashes(marked).select("_trusted", F.explode(_buckets(buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("_trusted").alias("target"))
    raw, target = [0] * buckets, [0] * buckets
    for row in counts.collect():
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    all_raw = math.log(sum(raw) + smoothing * buckets)
    all_target = math.log(sum(target) + smoothing * buckets)
    return [
        math.log(t + smoothing) - all_target - math.log(r + smoothing) + all_raw
        for r, t in zip(raw, target)
    ]


def statistics(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """One row per document: counts of the base rules and the mean log ratio of its n-grams."""
    buckets = len(ratios)
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    text = F.coalesce("text", F.lit(""))
    df = _word_hashes(common.text_column(docs))
    df = df.withColumn("_h4", _steps("_h2", 2)).withColumn("_h8", _steps("_h4", 4))
    twice = F.size(F.array_distinct("_h8")) < F.size("_h8")
    placed = F.transform("_h8", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    df = df.withColumn("_sorted", F.when(twice, F.sort_array(placed)).otherwise(none))
    same = lambda x, k: x["h"].eqNullSafe(F.get("_sorted", k)["h"])
    found = F.filter("_sorted", lambda x, k: same(x, k - 1) | same(x, k + 1))
    df = df.withColumn("_starts", F.sort_array(F.transform(found, lambda x: x["i"])))
    covered = F.transform(
        "_starts",
        lambda x, k: F.least(F.lit(WINDOW), F.coalesce(x - F.get("_starts", k - 1), F.lit(WINDOW))),
    )
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    grams = F.size("_h1") + F.size("_h2")
    total = F.aggregate(_buckets(buckets), F.lit(0.0), lambda a, b: a + F.get(table, b))
    return df.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.aggregate(covered, F.lit(0), lambda a, b: a + b).cast("long").alias("n_repeat_words"),
        F.when(grams > 0, total / grams).otherwise(F.lit(0.0)).alias("score"),
    )


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """Statistics of every document with the verdicts ``base_failed`` and ``kept``."""
    rows = statistics(docs, log_ratios(docs, trusted, buckets))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
