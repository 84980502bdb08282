"""Quality scores by co-training a text classifier and a page-metadata classifier.

The text view is which words a document has (hashed); the metadata view is its language, its
source, its stated number of characters and the layout of its page: lengths, and shares of letters
of different kinds. (Language and source alone would tell nothing of the labels here, so a view of
them could teach the other one nothing.) Both start from a bounded sample of labelled rows. In each round each view labels the unlabelled rows on which it is sure, of
all documents, and the other view learns from them. Labelled rows that neither was fitted on
calibrate both views and weigh them against each other. All documents get the combined score.

The vectors of both views are worked out once for all documents and stored; fits, exchange and
scores read them. What is fitted on all rows is fitted where the rows are, by sums of gradients.

Defined cases: null text is empty, a null language or source counts as its own value, a null
number of characters as none; equal rows get equal scores; null ids count as the empty text in the
split; labels without a document are not used, a document with two labels has the greater one;
without labels of both kinds every score is 0.5; an empty table gives no rows; other columns are
left out; very long texts are read whole.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from annalist.llm import common

#: Labelled rows that the views are first fitted on, at most (in expectation).
MOST_LABELLED = 12_000
MOST_IDS = 2_000_000
ROUNDS = 3
#: Steps of a fit on labelled rows, and of one on lent labels too, each a pass over all documents.
ITERATIONS, LENT_ITERATIONS = 25, 10
#: Rows of a task of a fit where there are more than its share by cores. Each step is a job, whose tasks the driver keeps
#: account of, so their number follows the rows and not the files that they lie in.
ROWS_A_TASK = 20_000
#: A view passes on a label when it is this sure.
SURE = 0.95
WORD_BUCKETS = 1 << 15
#: Buckets of languages, sources and both together: wide enough that few of them share one.
TAG_BUCKETS = 1 << 14


def features(docs: DataFrame) -> DataFrame:
    """``doc_id`` with the vectors of both views, all in DataFrame functions."""
    text = F.coalesce("text", F.lit(""))
    chars_told = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(0.0)
    df = docs.select("doc_id", "text", "lang", "source", F.coalesce(chars_told, F.lit(0.0)).alias("told"))
    df = df.withColumn("words", F.array_remove(F.split(text, common.WORD_BREAK), ""))
    n = F.size("words")
    chars = F.length(text)
    share = lambda x, of: F.when(of > 0, x / of).otherwise(F.lit(0.0))
    lines = F.size(F.split(text, "\n"))
    figures = [
        F.log1p(F.greatest("told", F.lit(0.0))), F.log1p(chars), F.log1p(n), F.log1p(lines), share(chars, n) / 10, share(n, lines) / 100,
        share(F.size(F.array_distinct("words")), n),
        share(F.regexp_count(text, F.lit("[A-Z]")), chars), share(F.regexp_count(text, F.lit("[0-9]")), chars),
        share(F.regexp_count(text, F.lit("[^\\w\\s.,]")), chars),
    ]
    named = lambda c: F.concat(F.lit(c), F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")))
    lang, source = named("lang"), named("source")
    df = df.withColumn("figures", array_to_vector(F.array(*[f.cast("double") for f in figures])))
    df = df.withColumn("tags", F.array(lang, source, F.concat_ws(" ", lang, source)))
    for column, output, size in (("words", "content", WORD_BUCKETS), ("tags", "tag_bits", TAG_BUCKETS)):
        df = HashingTF(inputCol=column, outputCol=output, numFeatures=size, binary=True).transform(df)
    # Told beforehand, else Spark would run a job to see the length, and fail on no rows.
    df = VectorSizeHint(inputCol="figures", size=len(figures), handleInvalid="optimistic").transform(df)
    meta = VectorAssembler(inputCols=["tag_bits", "figures"], outputCol="meta")
    # Without what the transformers note of the columns: a name for each bucket, which would go with the schema into
    # every plan, task and file.
    plain = [F.col(view).alias(view, metadata={}) for view in CoTrained.VIEWS]
    return meta.transform(df).select("doc_id", *plain)


def _thin(df: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows at most, by a hash of the id."""
    share = min(1.0, most / max(df.count(), 1))
    return df.where(F.pmod(F.xxhash64("doc_id", F.lit("co")), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))


class CoTrained:
    """The fitted views and the combination of their margins."""

    VIEWS = ("content", "meta")

    def __init__(self, models: dict | None, blend):
        self.models, self.blend = models, blend

    def margins(self, rows: DataFrame) -> DataFrame:
        for view, model in (self.models or {}).items():
            rows = model.transform(rows).withColumn(f"{view}_margin", vector_to_array(f"{view}_raw")[1])
            rows = rows.drop(f"{view}_raw", f"{view}_probability", "prediction")
        return rows

    def score(self, docs: DataFrame) -> DataFrame:
        """``doc_id, text_margin, meta_margin, score`` of every row."""
        return self.score_rows(features(docs))

    def score_rows(self, rows: DataFrame) -> DataFrame:
        """The same from rows that have their vectors."""
        if self.models is None:
            zero = F.lit(0.0)
            return rows.select("doc_id", zero.alias("text_margin"), zero.alias("meta_margin"), F.lit(0.5).alias("score"))
        a, b = (float(x) for x in self.blend.coefficients)
        total = a * F.col("content_margin") + b * F.col("meta_margin") + float(self.blend.intercept)
        return self.margins(rows).select(
            "doc_id", F.col("content_margin").alias("text_margin"), "meta_margin", (1 / (1 + F.exp(-total))).alias("score")
        )


def _fit(rows: DataFrame, view: str, iterations: int):
    return LogisticRegression(
        featuresCol=view, labelCol="y", predictionCol="prediction", rawPredictionCol=f"{view}_raw",
        probabilityCol=f"{view}_probability", regParam=1e-3, maxIter=iterations, aggregationDepth=2,
    ).fit(rows)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rounds: int = ROUNDS) -> CoTrained:
    """Fit both views by co-training on labels outside the held-out quarter of ids."""
    return fit_rows(common.stage(features(docs), "co-rows"), labels, label, rounds)


def fit_rows(rows: DataFrame, labels: DataFrame, label: str = "quality", rounds: int = ROUNDS) -> CoTrained:
    """``fit`` from stored rows that have their vectors."""
    spark = rows.sparkSession
    named = labels.select("doc_id", F.col(label).cast("double").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
    named = named.groupBy("doc_id").agg(F.max("y").alias("y"))
    usable = _thin(named.where(common.crc_mod(F.col("doc_id"), 4) != 2), MOST_LABELLED)
    labelled = common.stage(rows.join(common.by_size(spark, usable, 2 * MOST_LABELLED), "doc_id"), "co-labelled")
    pool = rows.join(common.by_size(spark, named.select("doc_id"), MOST_IDS), "doc_id", "left_anti")
    calibration = common.crc_mod(F.col("doc_id"), 5) == 0
    base, held = labelled.where(~calibration), labelled.where(calibration)
    kinds = lambda rows: rows.select("y").distinct().count()
    if kinds(base) < 2 or kinds(held) < 2:
        return CoTrained(None, None)
    lent = {view: None for view in CoTrained.VIEWS}
    models: dict = {}
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(rows.count() / ROWS_A_TASK))
    for number in range(rounds):
        for view in CoTrained.VIEWS:
            known = base.select("y", view)
            if lent[view] is None:
                models[view] = _fit(known.coalesce(tasks), view, ITERATIONS)
            else:
                models[view] = _fit(known.unionByName(lent[view]).coalesce(tasks), view, LENT_ITERATIONS)
        if number < rounds - 1:
            for view, other in (CoTrained.VIEWS, CoTrained.VIEWS[::-1]):
                chance = vector_to_array(f"{view}_probability")[1]
                sure = models[view].transform(pool).where((chance >= SURE) | (chance <= 1 - SURE))
                lent[other] = sure.select((chance >= SURE).cast("double").alias("y"), other)
    trained = CoTrained(models, None)
    margins = trained.margins(held)
    both = VectorAssembler(inputCols=["content_margin", "meta_margin"], outputCol="both").transform(margins)
    trained.blend = LogisticRegression(featuresCol="both", labelCol="y", regParam=1e-4, maxIter=50).fit(both.select("both", "y").coalesce(tasks))
    return trained
