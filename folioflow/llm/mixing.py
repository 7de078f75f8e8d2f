"""Mixing sources to target weights with soft domain membership. DataFrame functions only.

1. A labelled table (text, domain) fits a multinomial word classifier over a bounded vocabulary.
2. Every text gets a posterior over domains from all its words. Evidence is tempered: a text counts as at most
   ``evidence`` words, so memberships stay soft.
3. Projected-gradient least squares finds document rates r >= ``floor`` whose expected domain totals
   S_k = sum_d r_d n_d p_dk match targets T_k. The objective is sum_k (S_k - T_k)^2 / 2m_k, m_k being the totals at
   rate 1, in the metric diag(n_d); there the step size 1 always descends, because the matrix with entries
   sum_d n_d p_dk p_dj / m_k has row sums 1. A step needs the K totals only, so each is one aggregate over the posterior
   table; a document's rate is a closed expression of the steps so far, and no per-document state is written.

Rows that share an id are one document: words are pooled, the rate applies to each row. A null id is an id. Texts that
are null or hold no word get the prior as posterior, weight nothing and keep a rate of their own. A domain without mass
cannot be reached and is left out. With no labelled rows there is one domain, null, and every rate is 1 (or ``floor``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.words import SEPARATORS, fresh
from folioflow.session import Scratch


def words_of(text: Column) -> Column:
    return F.split(text, SEPARATORS)


@dataclass
class DomainClassifier:
    """``words``: at most ``vocabulary`` rows (word, ll_0, ll_1, ...). ``log_prior``: of each domain."""

    domains: list[str]
    log_prior: list[float]
    words: DataFrame


def sample_labelled(docs: DataFrame, labels: DataFrame, domain_col: str, *, fit_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, domain) of documents that ``labels`` covers: about ``fit_rows`` of them at most, chosen by id hash."""
    known = labels.select(F.col("doc_id").alias("_lid")).where("_lid IS NOT NULL").distinct()
    total = known.count()
    if total > fit_rows:
        known = known.where(F.pmod(F.xxhash64(F.lit(23), "_lid"), F.lit(1 << 30)) < int((1 << 30) * fit_rows / total))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"), F.col(domain_col).cast("string").alias("domain"))
    return rows.join(F.broadcast(known), F.col("_id") == F.col("_lid")).where("domain IS NOT NULL").select("text", "domain")


def fit_classifier(labelled: DataFrame, scratch: Scratch, *, vocabulary: int = 4096, max_domains: int = 64, smoothing: float = 0.5) -> DomainClassifier:
    labelled = scratch.table("labelled", labelled)
    shares = labelled.groupBy("domain").count().orderBy("domain").limit(max_domains + 1).collect()
    if len(shares) > max_domains:
        raise ValueError(f"more than {max_domains} domains")
    domains, total = [r.domain for r in shares], sum(r["count"] for r in shares)
    counts = labelled.select("domain", F.explode(words_of(F.col("text"))).alias("word")).where("word <> ''")
    counts = counts.groupBy("word").agg(F.count(F.lit(1)).alias("n"), *(F.count(F.when(F.col("domain") == d, 1)).alias(f"n_{k}") for k, d in enumerate(domains)))
    counts = scratch.table("words", counts.orderBy(F.desc("n"), "word").limit(vocabulary))
    size = counts.agg(F.count(F.lit(1)).alias("v"), *(F.coalesce(F.sum(f"n_{k}"), F.lit(0)).alias(f"t_{k}") for k in range(len(domains)))).first()
    score = [F.log((F.col(f"n_{k}") + smoothing) / (size[f"t_{k}"] + smoothing * max(size.v, 1))).alias(f"ll_{k}") for k in range(len(domains))]
    return DomainClassifier(domains, [math.log(r["count"] / total) for r in shares], counts.select("word", *score))


def posteriors(docs: DataFrame, model: DomainClassifier, *, id_col: str = "doc_id", text_col: str = "text", evidence: int = 6) -> DataFrame:
    """doc_id, n_tokens and p_0, p_1, ... for each distinct id."""
    k = range(len(model.domains))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode_outer(words_of(F.col(text_col).cast("string"))).alias("word"))
    rows = rows.withColumn("word", F.when(F.col("word") != "", F.col("word"))).join(F.broadcast(model.words), "word", "left")  # at most `vocabulary` rows
    known = F.count("ll_0") if model.domains else F.lit(0)
    rows = rows.groupBy("doc_id").agg(F.count("word").alias("n_tokens"), known.alias("known"), *(F.coalesce(F.sum(f"ll_{i}"), F.lit(0.0)).alias(f"s_{i}") for i in k))
    weight = evidence / F.greatest(F.lit(evidence), F.col("known"))
    rows = rows.select("doc_id", "n_tokens", *((F.col(f"s_{i}") * weight + model.log_prior[i]).alias(f"s_{i}") for i in k))
    if not model.domains:
        return rows.withColumn("p_0", F.lit(1.0))
    top = F.greatest(*(f"s_{i}" for i in k)) if len(k) > 1 else F.col("s_0")
    rows = rows.select("doc_id", "n_tokens", *(F.exp(F.col(f"s_{i}") - top).alias(f"e_{i}") for i in k))
    norm = sum((F.col(f"e_{i}") for i in k[1:]), F.col("e_0"))
    return rows.select("doc_id", "n_tokens", *((F.col(f"e_{i}") / norm).alias(f"p_{i}") for i in k))


def fit_rates(members: DataFrame, targets: list[float] | None, *, total: float | str = "same", floor: float = 0.0, tolerance: float = 1e-6, still: float = 1e-4, max_steps: int = 40) -> tuple[Column, dict]:
    """The rate of each row of ``members`` (n_tokens, p_k) as a column, and a report.

    ``targets``: each domain's share of the mixed tokens; None keeps the shares as they are. ``total``: the mixed
    tokens; "same" as now, "keep" so many that no domain shrinks. Steps end when all totals are within ``tolerance`` of
    their goals, or, where ``floor`` keeps them off, when none moves by more than the share ``still`` of its goal.
    """
    k = range(len([c for c in members.columns if c.startswith("p_")]))

    def totals(rate: Column) -> list[float]:
        row = members.agg(*(F.coalesce(F.sum(F.col("n_tokens") * rate * F.col(f"p_{i}")), F.lit(0.0)).alias(f"t_{i}") for i in k)).first()
        return [float(x) for x in row]

    rate = F.lit(max(1.0, floor))
    now = mass = totals(F.lit(1.0))
    if floor > 1:
        now = totals(rate)
    shares = targets or [m / (sum(mass) or 1) for m in mass]
    shares = [s if m > 0 else 0.0 for s, m in zip(shares, mass)]
    shares = [s / (sum(shares) or 1) for s in shares]
    tokens = sum(mass) if total == "same" else max([m / s for m, s in zip(mass, shares) if s > 0], default=0.0) if total == "keep" else float(total)
    goal, steps = [s * tokens for s in shares], 0
    off = lambda: max((abs(n - g) / max(g, 1e-9 * tokens) for n, g, m in zip(now, goal, mass) if m > 0), default=0.0)
    while steps < max_steps and off() > tolerance:
        gradient = [(n - g) / m if m > 0 else 0.0 for n, g, m in zip(now, goal, mass)]
        move = sum((F.col(f"p_{i}") * gradient[i] for i in k), F.lit(0.0))
        rate = F.greatest(F.lit(floor), rate - move)
        last, now, steps = now, totals(rate), steps + 1
        if floor > 0 and all(abs(n - l) <= still * max(g, 1e-9 * tokens) for n, l, g in zip(now, last, goal)):
            break
    return rate, {"before": mass, "goal": goal, "after": now, "steps": steps, "off": off()}


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = 4096, evidence: int = 6, **how) -> tuple[DataFrame, dict]:
    """doc_id, n_tokens, domain (likeliest), posterior (by domain in order) and rate of each id, and the fit's report."""
    scratch = Scratch(docs.sparkSession)
    model = fit_classifier(labelled, scratch, vocabulary=vocabulary)
    members = scratch.table("members", posteriors(docs, model, id_col=id_col, text_col=text_col, evidence=evidence))
    scratch.drop("labelled")
    rate, report = fit_rates(members, [targets.get(d, 0.0) for d in model.domains] if targets and model.domains else None, **how)
    best = F.lit(None).cast("string")
    ps = [F.col(f"p_{i}") for i in range(max(1, len(model.domains)))]
    for i in reversed(range(len(model.domains))):
        best = F.when(ps[i] == (F.greatest(*ps) if len(ps) > 1 else ps[0]), F.lit(model.domains[i])).otherwise(best)
    return members.select("doc_id", "n_tokens", best.alias("domain"), F.array(*ps).alias("posterior"), rate.alias("rate")), report | {"domains": model.domains}


def realise(docs: DataFrame, rates: DataFrame, *, id_col: str = "doc_id", seed: int = 11) -> DataFrame:
    """``docs`` with each row as often as its rate says: the whole part always, the rest by a hash of the id."""
    key, rate, copy = fresh(docs, "_mix_id", "_mix_rate", "_mix_copy")
    r = rates.select(F.col("doc_id").alias(key), F.col("rate").alias(rate))
    chance = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 40)) / float(1 << 40)
    copies = (F.floor(rate) + F.when(chance < F.col(rate) - F.floor(rate), 1).otherwise(0)).cast("int")
    rows = docs.join(r, F.col(id_col).eqNullSafe(F.col(key)))
    rows = rows.withColumn(copy, F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))))
    return rows.select(*docs.columns)
