"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.words import fold


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, *, fit_rows: int, id_col: str = "doc_id", label_id: str = "doc_id", fold_modulus: int = 3, fold_out: int = 1) -> DataFrame:
    """``docs`` rows with a label, as all columns of ``docs`` plus ``_label`` (int 0 or 1).

    Only labels outside the held-out fold count. An id labelled more than once counts if its labels agree; null ids
    and null labels never count. When more than ``fit_rows`` ids are labelled, a sample by id hash with that
    expected size is taken: the bound on what a fit reads.
    """
    known = (
        labels.select(F.col(label_id).alias("_lid"), F.col(label).cast("int").alias("_label"))
        .where(F.col("_lid").isNotNull() & F.col("_label").isin(0, 1) & (fold("_lid", fold_modulus) != fold_out))
        .groupBy("_lid")
        .agg(F.min("_label").alias("_label"), F.max("_label").alias("_other"))
        .where("_label = _other")
        .drop("_other")
    )
    total = known.count()
    if total > fit_rows:
        known = known.where(F.pmod(F.xxhash64(F.lit(17), "_lid"), F.lit(1 << 30)) < int((1 << 30) * fit_rows / total))
    return docs.join(F.broadcast(known), F.col(id_col) == F.col("_lid")).drop("_lid")
