"""A training-data pipeline over ``documents``: filter, deduplicate, cut repeats, mix, tokenize.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``, of which
``doc_id``, ``text``, ``lang`` and ``n_chars`` are read and others are passed through, whatever their names. Rows are told
apart as rows: ids may be null or repeat, and repeated rows are rows of their own except as copies of each other. An empty
table gives an empty result. Very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import bpe, jaccard_join, mixing, quality_mil, substring_dedup
from folioflow.llm.queries import table, tokenizer_path
from folioflow.llm.words import fresh
from folioflow.session import Scratch

#: Shares of the mixed tokens by domain.
TARGETS = {"en": 0.5, "de": 0.18, "fr": 0.18, "es": 0.14}
#: SQL has no form of the learned classifier.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network accepts. A score of exactly 0.5 is accepted; null and empty texts score as a passage
    without words."""
    network, (score,) = quality_mil.fit(docs, table(spark, sf_dir, "labels")), fresh(docs, "_quality")
    return quality_mil.score(docs, network, out_col=score).where(F.col(score) >= 0.5).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id, one without an id if no other is there,
    and any one of those that tie. Null, empty and wordless texts are no duplicates of each other: all stay."""
    scratch, (key, kept_key) = Scratch(spark), fresh(docs, "_key", "_kept")
    unclear = docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").limit(1).count()
    # rows that share an id, or have none, are told apart by a number of their own, written once so that it stays
    rows = scratch.table("keyed", docs.withColumn(key, F.monotonically_increasing_id())) if unclear else docs.withColumn(key, F.col("doc_id"))
    found = jaccard_join.join(rows, id_col=key, links=False).select(F.col("doc_id").alias("_id"), F.col("component_id").alias("_first"))
    if unclear:
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_id")
        ranked = found.join(rows.select(F.col(key).alias("_row"), "doc_id"), F.col("_id") == F.col("_row")).groupBy("_first").agg(F.min(order).alias("_least"))
        kept = ranked.select(F.col("_least._id").alias("_id"))
    else:
        kept = found.where(F.col("_id") == F.col("_first")).select("_id")
    kept = scratch.table("kept", kept.select(F.col("_id").alias(kept_key)))
    return rows.join(kept, F.col(key) == F.col(kept_key)).select(*docs.columns)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated windows; the words left are joined by one space. Texts that lose nothing, null
    ones too, stay as they are."""
    (repeats,) = fresh(docs, "repeats")
    rows = substring_dedup.remove_repeats(docs, out_col=repeats)
    cut, kept = F.col(f"{repeats}.removed") > 0, F.col(f"{repeats}.kept")
    new = {"text": F.when(cut, kept).otherwise(F.col("text")), "n_chars": F.when(cut, F.length(kept).cast("long")).otherwise(F.col("n_chars"))}
    return rows.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their rates, which bring the languages' tokens to ``TARGETS``; none is dropped. Rows that share
    an id, or have none, share a rate; a text without words has a rate of its own."""
    labelled = mixing.sample_labelled(docs, table(spark, sf_dir, "labels"), "lang", fit_rows=4_000)
    rates, _ = mixing.mix(docs, labelled, TARGETS, total="keep", floor=1.0)
    return mixing.realise(docs, rates)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids' and decoded text's digests of each document; a null text is encoded as the empty one."""
    return bpe.round_trip(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_dedup_stage),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", bpe_encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each stage's result written to the shared folder and read again."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.table(f"stage-{k}", docs)
    return docs
