"""The pipeline against brute force, and what the driver asks of its stages."""

import random

import corpus_pipeline
from annalist.llm import common
from tests.llm.conftest import sentence


def documents(spark, folder):
    rng = random.Random(6)
    shared, leak = sentence(rng, 55, 4000), sentence(rng, 30, 4000)
    rows, labels = [], []
    for i in range(160):
        toxic = i % 8 == 0
        words = sentence(rng, 120, 4000).split()
        for _ in range(5 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "nasty"]) + rng.choice(["", "x", "yy"]))
        rows.append([i, " ".join(words)])
        labels.append((i, 1, int(toxic)))
    rows[17][1] = rows[18][1] = rows[19][1]
    for i in (33, 34):
        rows[i][1] += "\n" + shared
    rows[41][1] += "\n" + leak.title()
    rows += [[200, None], [201, ""], [202, None], [None, "only one of these"]]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return {i: t for i, t in rows}, shared


def test_stages(spark, tmp_path):
    texts, shared = documents(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = common.stage(function(spark, docs, str(tmp_path)), "test-pipeline")
        assert docs.columns == columns
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = {i for i in texts if i is None or i >= 200 or i % 8}
    assert set(kept["toxicity"]) == clean
    # The three equal texts leave one, and so do the three without words.
    assert set(kept["near_duplicates"]) == clean - {18, 19, 201, 202}
    cut = kept["repeated_passages"]
    assert set(cut) == set(kept["near_duplicates"])
    for i, text in cut.items():
        if i in (33, 34):
            assert shared not in text and text.split() == texts[i].replace(shared, "").split()
        else:
            assert text == (texts[i] or "")
    assert set(kept["decontamination"]) == set(cut) - {41}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(kept["decontamination"])


def test_run(spark, sf):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "decontamination", "packing"]
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and all(0 <= r["offset"] < 4096 for r in rows)
