"""Scores, models and statistics against brute force and held-out labels."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from annalist.llm import common, cotraining, kneser_ney, ngram_ratio, toxicity
from tests.llm.conftest import WORDS, sentence


def brute_statistics(text):
    words = WORDS.findall(text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_statistics_match_brute_force(spark, odd, odd_rows):
    trusted = spark.createDataFrame([(6,), (7,), (7,), (None,)], "doc_id long")
    got = ngram_ratio.judge(odd, trusted, buckets=512)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = sorted(((r["doc_id"], *(r[n] for n in names)) for r in got.collect()), key=repr)
    assert rows == sorted(((r[0], *brute_statistics(r[1])) for r in odd_rows), key=repr)
    for r in got.collect():
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed
        assert r["kept"] == (not failed and r["score"] >= ngram_ratio.THRESHOLD)


def test_ratio_of_two_multinomials(spark):
    docs = spark.createDataFrame([(1, "good good fine"), (2, "bad bad fine"), (3, None)], "doc_id long, text string")
    trusted = spark.createDataFrame([(1,)], "doc_id long")
    ratios = ngram_ratio.log_ratios(docs, trusted, buckets=1 << 12)
    scores = {r["doc_id"]: r["score"] for r in ngram_ratio.statistics(docs, ratios).collect()}
    # Ten n-grams in all, five of them trusted; "good" 2 of 2, "bad" 0 of 2, "fine" 1 of 2.
    size = 1 << 12
    log = lambda t, r: math.log((t + 1) / (5 + size)) - math.log((r + 1) / (10 + size))
    assert scores[1] == pytest.approx((2 * log(2, 2) + log(1, 2) + log(1, 1) + log(1, 1)) / 5)
    assert scores[2] == pytest.approx((2 * log(0, 2) + log(1, 2) + 2 * log(0, 1)) / 5)
    assert scores[3] == 0


def test_ratio_uses_no_python(odd, spark):
    plan = ngram_ratio.judge(odd, spark.createDataFrame([(6,)], "doc_id long"), buckets=64)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_ratio_of_empty_table(none):
    assert ngram_ratio.judge(none, none.select("doc_id"), buckets=64).count() == 0


def brute_model(rows, used):
    count, pairs, docs = Counter(), Counter(), []
    for i, text in rows:
        words = [*WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), None]
        docs.append((i, words))
        if used(i):
            count.update(words)
            pairs.update(zip(["<start>", *words], words))

    def cuts(n):
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        found = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0 for k in (1, 2, 3)]
        return [0, *(min(max(d, 0), k) for k, d in zip((1, 2, 3), found))]

    after, context, kinds = Counter(), Counter(), defaultdict(Counter)
    for (u, w), n in pairs.items():
        after[w] += 1
        context[u] += n
        kinds[u][min(n, 3)] += 1
    d, e = cuts(Counter(pairs.values())), cuts(Counter(after.values()))
    rest = sum(e[min(n, 3)] for n in after.values()) / len(pairs) if pairs else 1

    def word(w):
        return ((after[w] - e[min(after[w], 3)]) / len(pairs) if pairs else 0) + rest / (len(count) + 1)

    def chance(u, w):
        if not context[u]:
            return word(w)
        n = pairs[u, w]
        return (n - d[min(n, 3)] + sum(d[k] * kinds[u][k] for k in (1, 2, 3)) * word(w)) / context[u]

    total = sum(count.values())
    share = total + 0.5 * (len(count) + 1)
    for i, words in docs:
        base = sum(math.log10((count[w] + 0.5) / share) for w in words)
        score = sum(math.log10(chance(u, w)) for u, w in zip(["<start>", *words], words))
        yield i, len(words), sum(count[w] > 0 for w in words), base, score


@pytest.mark.parametrize("range_bytes", [24_000_000, 2_000])
def test_language_model_matches_brute_force(odd, odd_rows, monkeypatch, range_bytes):
    monkeypatch.setattr(kneser_ney, "RANGE_BYTES", range_bytes)
    model = kneser_ney.train(odd, common.crc_mod(F.col("doc_id"), 5) != 1)
    assert (model.ranges > 1) == (range_bytes < 10_000)
    got = sorted(kneser_ney.score(odd, model).collect(), key=lambda r: repr(tuple(r)[:3]))
    used = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1
    want = sorted(brute_model([r[:2] for r in odd_rows], used), key=lambda r: repr(r[:3]))
    assert [tuple(r)[:3] for r in got] == [r[:3] for r in want]
    for r, w in zip(got, want):
        assert tuple(r)[3:] == pytest.approx(w[3:], rel=1e-9)


def test_counts_beyond_a_byte(spark):
    docs = spark.createDataFrame([(1, "a b " * 700)], "doc_id long, text string")
    model = kneser_ney.train(docs)
    keys = kneser_ney.pair_hash(kneser_ney.word_hashes([b"a"]), kneser_ney.word_hashes([b"b"]))
    assert kneser_ney.Reader(model).pairs(keys).tolist() == [700.0]


def test_language_model_of_nothing(none, odd):
    model = kneser_ney.train(none)
    assert model.tokens == 0
    assert {r["score"] for r in kneser_ney.score(odd, model).collect()} == {0.0}
    assert kneser_ney.score(none, model).count() == 0


def test_toxic_held_out(spark, sf):
    """Some labels are wrong: a few toxic texts have no word of their own."""
    big = sf.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id")
    rows = scored.where(common.crc_mod(F.col("doc_id"), 4) == 2).select("score", "toxic").collect()
    assert sum((r["score"] >= 0.3) == bool(r["toxic"]) for r in rows) >= 0.98 * len(rows)
    clean = [r["score"] for r in rows if not r["toxic"]]
    assert sum(s >= 0.3 for s in clean) <= 0.005 * len(clean)


@pytest.fixture(scope="module")
def model():
    words = "idiot stupid loser the there then that weather house mouse simple people table".split()
    counts = np.zeros(toxicity.SIZE**3, np.int64)
    for w in words * 20:
        c = [0, 0, *map(toxicity.code, w), 0]
        for i in range(len(c) - 2):
            counts[(c[i] * 28 + c[i + 1]) * 28 + c[i + 2]] += 1
    return toxicity.Model(counts, {"idiot": 5.0, "stupid": 5.0}, 1.0, -3.0)


@pytest.mark.parametrize("word", ["1d10t", "1d1ot", "idi0t", "iiidiiiooot", "i.d.i.o.t", "i-d_i*o.t", "IDIOT!!", "id|ot", "iiddiioott"])
def test_disguised_words_are_restored(model, word):
    assert toxicity.Channel(model.trigrams).word(word.lower()) == "idiot"


def test_spaced_letters_are_restored(model):
    scorer = toxicity.Scorer(model)
    assert "stupid" in scorer.channel.words("the s t u p i d house", scorer.channel.word)
    assert scorer.evidence("the s t u p i d 1d1ot") > scorer.evidence("the idiot") > scorer.evidence("the house") == 0


def test_toxicity_of_odd_rows(odd, none, model, spark):
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(none, model).count() == 0
    assert toxicity.reject(odd, model, 2.0).columns == odd.columns
    assert toxicity.reject(odd, model, 2.0).count() == odd.count()
    labels = spark.createDataFrame([(1, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(odd, toxicity.fit(odd, labels)).collect()} == {0.0}


def test_quality_held_out(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    scored = cotraining.fit(docs, labels, rounds=2).score(docs).join(labels, "doc_id")
    rows = scored.where(common.crc_mod(F.col("doc_id"), 4) == 2).select("score", "quality").collect()
    assert sum((r["score"] >= 0.5) == bool(r["quality"]) for r in rows) >= 0.9 * len(rows)


def test_quality_of_odd_rows_by_fitted_views(odd, odd_rows, none, spark, sf, monkeypatch):
    """Nulls, empty and very long texts meet a fitted model, in the exchange and in the scores."""
    big = sf.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    both = docs.select(columns).unionByName(odd.select(*columns).withColumn("doc_id", -F.col("doc_id")))
    trained = cotraining.fit(both, labels, rounds=2)
    assert trained.models is not None
    rows = trained.score(odd).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add(r["score"])
    assert len(by[4]) == 1 and len(by) == len({r[0] for r in odd_rows})
    assert trained.score(none).count() == 0


def test_fits_have_few_tasks_on_many_files(spark, monkeypatch):
    """Each step of a fit is a job; the driver would keep account of a task for each file in each of them."""
    docs = spark.range(120, numPartitions=1).selectExpr("id AS doc_id", "concat('word', id) AS text", "'en' AS lang", "'s' AS source")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality")
    stored = common.stage(cotraining.features(docs).repartition(20), "co-rows")

    def fitted(rows, *_):
        raise RuntimeError(f"tasks: {rows.rdd.getNumPartitions()}")

    monkeypatch.setattr(cotraining, "_fit", fitted)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    # Each file is a task of its own.
    spark.conf.set("spark.sql.files.openCostInBytes", "200m")
    try:
        assert stored.rdd.getNumPartitions() >= 20
        with pytest.raises(RuntimeError, match=f"tasks: [1-{spark.sparkContext.defaultParallelism}]$"):
            cotraining.fit_rows(stored, labels)
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


def test_vectors_have_no_names_of_buckets(odd):
    """The schema goes into every plan, task and file; with a name for each of its buckets a vector's took 600,000 characters."""
    stored = common.stage(cotraining.features(odd), "co-rows")
    assert all(not field.metadata for field in stored.schema.fields)
    assert len(stored.schema.json()) < 5_000


def test_views_of_rows(spark):
    """The text view is the words alone; a null language or source is not an empty one."""
    rows = [(1, "one text", "en", "s", 5), (2, "one  TEXT", "en", "s", 5), (3, "text one", "de", None, None), (4, "text one", "de", "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in cotraining.features(docs).collect()}
    assert got[1]["content"] == got[3]["content"] != got[2]["content"]
    assert got[1]["meta"] != got[3]["meta"] != got[4]["meta"]


def test_quality_of_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, quality int")
    trained = cotraining.fit(odd, labels)
    assert {r["score"] for r in trained.score(odd).collect()} == {0.5}
    assert trained.score(none).count() == 0
    assert sentence(random.Random(1), 3).count(" ") == 2
