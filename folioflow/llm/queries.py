"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import ann, bpe, jaccard_join, lm_scoring, mixing, quality_mil, quality_rules, sharding, substring_dedup, toxicity

#: Shares of the mixed tokens by domain.
TARGETS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = mixing.sample_labelled(docs, table(spark, sf_dir, "labels"), "lang", fit_rows=4_000)
    return mixing.mix(docs, labelled, TARGETS)[0]


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0]


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(table(spark, sf_dir, "documents"), 8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op10_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    import corpus_pipeline

    ops = (op1_mixing, op2_quality_rules, op3_bpe, op4_sharding, op5_ann, op6_jaccard_join, op7_toxicity, op8_substring_dedup, op9_lm_scoring, op10_quality_mil)
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

#: Window by window and shingle by shingle; meant for the small scale on which queries are compared.
_SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
p AS (SELECT doc_id, len(ws) AS n, ws, unnest(generate_series(1, len(ws) - 34)) AS i FROM w WHERE len(ws) >= 35),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS s FROM p),
r AS (SELECT s FROM k GROUP BY s HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS j FROM k JOIN r USING (s)),
a AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS j FROM w),
kept AS (SELECT a.doc_id, count(*) AS n_kept, string_agg(a.ws[a.j], ' ' ORDER BY a.j) AS t
         FROM a LEFT JOIN c ON a.doc_id = c.doc_id AND a.j = c.j WHERE c.j IS NULL GROUP BY a.doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(len(w.ws) - coalesce(kept.n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_substring_dedup": _SUBSTRINGS}


