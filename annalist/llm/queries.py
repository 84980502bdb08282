"""The registered queries of this folder's operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from annalist.llm import (
    alignment, common, conversations, cotraining, decontaminate, golay, kneser_ney, licenses, ngram_ratio, packing, phrases,
    token_counts, toxicity, training_order,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        (common.crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.materialise(table(spark, sf_dir, "documents"), tokenizer())[1]


def op3_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.stage(cotraining.features(table(spark, sf_dir, "documents")), "co-rows")
    scored = cotraining.fit_rows(rows, table(spark, sf_dir, "labels")).score_rows(rows)
    return scored.select(
        "doc_id",
        (common.crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"),
        "text_margin", "meta_margin", "score",
        (F.col("score") >= 0.5).alias("kept"),
    )


def op4_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def op5_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = common.crc_mod(F.col("doc_id"), 5) == 1
    model = kneser_ney.train(docs, ~held_out)
    return kneser_ney.perplexity(kneser_ney.score(docs, model)).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity",
    )


def op7_license_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer()).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified"
    )


def op10_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return ngram_ratio.judge(table(spark, sf_dir, "documents"), trusted).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "score",
    )


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"), tokenizer())


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return alignment.judge(docs, tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))


QUERIES = (
    op1_toxicity, op2_training_order, op3_cotraining, op4_golay_simhash, op5_phrase_automata,
    op6_kneser_ney, op7_license_compression, op8_qgram_decontamination, op9_best_fit_packing, op10_ngram_ratio,
    op11_token_counts, op12_tokenizer_alignment, op13_conversation_repair,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


#: Windows of 35 words that start in two places or more, and the words they cover.
_REPEATS = """
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
windows AS (
  SELECT r, unnest(range(1, len(w) - 33)) AS s, w FROM split WHERE len(w) >= 35),
named AS (SELECT r, s, sha256(array_to_string(w[s:s + 34], ' ')) AS h FROM windows),
covered AS (
  SELECT DISTINCT r, s + unnest(range(0, 35)) AS p FROM named
  WHERE h IN (SELECT h FROM named GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT r, count(*) AS n, list(p) AS ps FROM covered GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ')
                   ELSE coalesce((SELECT string_agg(x, ' ' ORDER BY i)
                                  FROM (SELECT unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i)
                                  WHERE NOT list_contains(ps, i)), '') END) AS kept_sha256
FROM split LEFT JOIN gone USING (r)"""


def _then(path: str, cost: str, letter: str, role: str = "", text: str = "''") -> str:
    """SQL of a path with one more edit; null where the path is."""
    more = f" || chr(10) || {role} || ':' || {text}" if role else ""
    return (
        f"CASE WHEN {path} IS NOT NULL THEN "
        f"{{'c': {path}.c + {cost}, 'a': {path}.a || '{letter}', 't': {path}.t{more}}} END"
    )


def _with_insert() -> str:
    """The four states' paths, after one insertion or none."""
    user = ", ".join(_then(x, "3", "I", "'user'") for x in ("p0", "p1", "p3"))
    return f"""p0 AS q0, p1 AS q1, least(p2, {user}) AS q2, least(p3, {_then("p2", "3", "I", "'assistant'")}) AS q3"""


def _edited(source: str, role: str) -> str:
    """Keep, if the role fits, or give the role, from one state; null for rows that must go."""
    kept = f"CASE WHEN NOT must AND role[1] = '{role[0]}' THEN {_then(source, 'extra', 'K', 'role', 'text')} END"
    if role == "system":
        return kept
    named = _then(source, "3 + extra", "R", f"'{role}'", "text")
    return f"{kept}, CASE WHEN NOT must THEN {named} END"


#: The paths of all conversations advance together, one row at a time; paths are compared by
#: cost, then by their letters. The checksum is computed byte by byte from its table.
_REPAIRED = f"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
keyed AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k,
         dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g
  FROM conversations),
marked AS (
  SELECT g, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT)),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS f
  FROM keyed, crc_table),
damaged AS (
  SELECT g, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
         CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy
  FROM marked WHERE f <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
judged AS (
  SELECT *, lag(role[1]) OVER (PARTITION BY g ORDER BY i) || role[1] AS pair,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
              WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 'd'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault
  FROM placed),
rows_in AS (
  SELECT g, i, role, text, fault IN ('b', 'd') AS must, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS extra FROM judged),
walk AS (
  SELECT DISTINCT g, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}} AS p0,
         CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS p1,
         CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS p2,
         CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS p3
  FROM keyed
  UNION ALL
  SELECT g, i + 1, {_then("q0", "4", "D")}, least({_then("q1", "4", "D")}, {_edited("q0", "system")}),
         least({_then("q2", "4", "D")}, {_edited("q0", "user")}, {_edited("q1", "user")}, {_edited("q3", "user")}),
         least({_then("q3", "4", "D")}, {_edited("q2", "assistant")})
  FROM (SELECT walk.g, walk.i, role, text, must, extra, {_with_insert()}
        FROM walk JOIN rows_in ON rows_in.g = walk.g AND rows_in.i = walk.i + 1)),
last AS (SELECT g, max(i) AS i FROM walk GROUP BY g),
chosen AS (
  SELECT g, least(q0, q3) AS p FROM (SELECT walk.g, {_with_insert()} FROM walk JOIN last USING (g, i))),
counts AS (
  SELECT g, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY g)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       p.c AS cost, p.a AS audit, sha256(substr(p.t, 2)) AS repaired_sha256
FROM (SELECT DISTINCT g, conv_id FROM keyed) JOIN chosen USING (g) LEFT JOIN counts USING (g)"""


def oracle_sql() -> dict[str, str]:
    return {"op5_phrase_automata": _REPEATS, "op13_conversation_repair": _REPAIRED}
