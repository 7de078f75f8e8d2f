"""Toxicity: a weighted lexicon matched by Aho-Corasick in folded text.

Folding lower-cases, maps look-alike letters of other scripts and full-width forms to Latin, undoes digit and sign
substitutions inside a word, and turns other ASCII punctuation into blanks. Lexicon entries are stems: they match where a
word starts with them, or, if marked whole, where a word equals them. Entries and weights are learned from labelled
texts: a stem's weight is its log odds of occurring in a toxic text. A longer phrase that holds an entry, but occurs in
clean labelled texts only, is learned as an exception and hides the entry; more exceptions can be given.

The score is a logistic function of the summed weights of distinct and of all hits, the latter divided by the square root
of the length in words, so that one hit counts less in a long text. Null and empty texts have no hits and score as such.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.labels import labelled_sample
from folioflow.llm.words import fold
from folioflow.session import Scratch, ship

#: Letters of other scripts that look like Latin ones, and what stands for letters inside words.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

_KEPT = set(SUBSTITUTES) | {"'"}
_TABLE = {ord(c): " " for c in map(chr, range(128)) if not c.isalnum() and c not in _KEPT} | {ord(k): v for k, v in LOOKALIKES.items()}
_TABLE |= {0xFEE0 + c: chr(c).lower() if chr(c).isalnum() else " " for c in range(0x21, 0x7F)}
_TABLE |= {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0xFEFF)}
_SUBSTITUTED = re.compile(r"(?<=[^\W\d_])[013457@$!]+(?=[^\W\d_])|(?<![^\s])[1345@$]+(?=[^\W\d_])")
_SIGNS = re.compile(r"[@$!]+")
_INNER = str.maketrans(SUBSTITUTES)


def folded(text: str | None) -> str:
    """The folded text; words are separated by blanks, and one blank stands before the first and after the last."""
    if not text:
        return "  "
    out = text.lower().translate(_TABLE)
    if _ODD.search(out):
        out = _SUBSTITUTED.sub(lambda m: m[0].translate(_INNER), out)
        out = _SIGNS.sub(" ", out)
    return f" {out} "


_ODD = re.compile(r"[013457@$!]")


@dataclass
class Lexicon:
    """``entries``: " stem" or " word " to weight. ``exceptions``: folded phrases whose inside is not matched.
    ``line``: intercept and weights of the summed distinct weights, of the length-normalised sum and of any hit at all."""

    entries: dict[str, float]
    exceptions: tuple[str, ...] = ()
    line: tuple[float, float, float, float] = (-4.0, 1.0, 1.0, 3.0)

    def automaton(self):
        import ahocorasick

        out = ahocorasick.Automaton()
        for phrase in self.exceptions:
            out.add_word(phrase, (len(phrase), None, phrase))
        for entry, weight in self.entries.items():
            if entry not in self.exceptions:
                out.add_word(entry, (len(entry), weight, entry))
        if len(out):
            out.make_automaton()
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        z = self.line[0] + features @ np.array(self.line[1:])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def hits(automaton, text: str | None) -> tuple[float, float, float, int, int]:
    """Summed weights of distinct hits; all hits' weights over the root of the length; 1.0 if any; hits; words."""
    plain = folded(text)
    words = len(plain.split())
    found = list(automaton.iter(plain)) if len(automaton) else []
    hidden = [(end + 1 - size, end + 1) for end, (size, weight, _) in found if weight is None]
    kept = [(w, e) for end, (size, w, e) in found if w is not None and not any(a <= end + 1 - size and end + 1 <= b for a, b in hidden)]
    return sum(dict((e, w) for w, e in kept).values()), sum(w for w, _ in kept) / max(1, words) ** 0.5, float(bool(kept)), len(kept), words


def _stems(text: str, shortest: int, longest: int) -> set[str]:
    out = set()
    for w in set(folded(text).split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in range(shortest, min(len(w), longest) + 1))
    return out


def _count_stems(shortest: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, clean = Counter(), Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (toxic if label else clean).update(_stems(text or "", shortest, longest))
            keys = list(toxic.keys() | clean.keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], names=["stem", "toxic", "clean"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Newton's method."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(a.shape[1])
        w = w - np.linalg.solve(h, a.T @ (p - y) + ridge * w)
    return w


def _choose(rows: list, n_toxic: int, n_clean: int, max_entries: int, precision: float) -> dict[str, float]:
    """Short stems first among equals: an entry is left out if a chosen stem starts it and is as precise."""
    entries: dict[str, float] = {}
    for stem, t, c in sorted(rows, key=lambda r: (len(r[0].strip()), r[0])):
        odds = float(np.log(((t + 0.5) / (n_toxic + 1)) / ((c + 0.5) / (n_clean + 1))))
        share = (t / (n_toxic + 1)) / (t / (n_toxic + 1) + c / (n_clean + 1))
        if share < precision or odds <= 0:
            continue
        word = stem.strip()
        if any(f" {word[:k]}" in entries for k in range(1, len(word) + (stem[-1] == " "))):
            continue
        entries[stem] = odds
    return dict(sorted(entries.items(), key=lambda e: (-e[1], e[0]))[:max_entries])


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", fit_rows: int = 8_000, max_entries: int = 2_000, least: int = 5, precision: float = 0.97, shortest: int = 4, longest: int = 12, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon from about ``fit_rows`` labelled texts at most; labels of the fold with remainder 1 are left out."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    rows = scratch.table("fit", labelled_sample(rows, labels, label, fit_rows=fit_rows, id_col="_id").select("_text", "_label"))
    totals = dict(rows.groupBy("_label").count().collect())
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon({}, line=(-30.0 if not n_toxic else 30.0, 0.0, 0.0, 0.0) if totals else (-4.0, 1.0, 1.0, 3.0))
    counts = rows.mapInArrow(_count_stems(shortest, longest), "stem string, toxic long, clean long")
    counts = counts.groupBy("stem").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where((F.col("t") >= least) & (F.col("t") * n_clean * (1 - precision) >= F.col("c") * n_toxic * precision))
    entries = _choose([tuple(r) for r in counts.orderBy(F.desc(F.col("t") / (F.col("c") + 1)), "stem").limit(20 * max_entries).collect()], n_toxic, n_clean, max_entries, precision)
    lexicon = Lexicon(entries, tuple(folded(e) for e in exceptions))
    learned = _learn_exceptions(spark, rows, lexicon)
    lexicon = Lexicon(entries, tuple(dict.fromkeys(lexicon.exceptions + learned)))
    found = rows.select("_label", _hits_udf(spark, lexicon)(F.col("_text")).alias("h")).select("_label", "h.distinct", "h.dense", "h.any").toArrow()
    x = np.column_stack([found.column(c).to_numpy() for c in ("distinct", "dense", "any")])
    return Lexicon(entries, lexicon.exceptions, tuple(_logistic(x, found.column("_label").to_numpy().astype(float))))


def _learn_exceptions(spark: SparkSession, rows: DataFrame, lexicon: Lexicon, least: int = 3, most: int = 500) -> tuple[str, ...]:
    """Two-word phrases around an entry that ``least`` clean texts hold and no toxic one."""
    shared = spark.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value.automaton()
        for batch in batches:
            toxic, clean = Counter(), Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                plain, phrases = folded(text), set()
                for end, (size, _, _) in automaton.iter(plain) if len(automaton) else ():
                    start = end + 1 - size
                    stop = plain.find(" ", start + 1)
                    after = re.match(r" +(\S+) ", plain[stop:])
                    before = re.search(r" (\S+) *$", plain[max(0, start - 80) : start])
                    word = plain[start + 1 : stop]
                    phrases.update([f" {word} {after[1]} "] if after else [])
                    phrases.update([f" {before[1]} {word} "] if before else [])
                (toxic if label else clean).update(phrases)
            keys = list(toxic.keys() | clean.keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], names=["phrase", "toxic", "clean"])

    found = rows.mapInArrow(run, "phrase string, toxic long, clean long").groupBy("phrase").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    return tuple(r.phrase for r in found.where((F.col("t") == 0) & (F.col("c") >= least)).orderBy(F.desc("c"), "phrase").limit(most).collect())


def _hits_udf(spark: SparkSession, lexicon: Lexicon):
    shared = spark.sparkContext.broadcast(lexicon)  # at most max_entries entries and a few hundred exceptions

    @F.arrow_udf("struct<distinct:double,dense:double,any:double,n_hits:bigint,n_words:bigint,score:double>")
    def lexicon_hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = shared.value.automaton()
        for texts in batches:
            rows = [hits(automaton, t) for t in texts.to_pylist()]
            x = np.array([r[:3] for r in rows], float).reshape(len(rows), 3)
            yield pa.StructArray.from_arrays(
                [pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(x[:, 2]), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64()), pa.array(shared.value.score(x))],
                names=["distinct", "dense", "any", "n_hits", "n_words", "score"],
            )

    return lexicon_hits.asNondeterministic()


def score(docs: DataFrame, lexicon: Lexicon, *, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """``docs`` with a struct of hits and score."""
    ship(docs.sparkSession)
    return docs.withColumn(out_col, _hits_udf(docs.sparkSession, lexicon)(F.col(text_col).cast("string")))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, **how) -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits and n_words of each row."""
    lexicon = learn(docs, labels, id_col=id_col, text_col=text_col, **how)
    rows = score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), lexicon)
    return rows.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "toxicity.score", F.when(F.col("toxicity.score") >= threshold, 1).otherwise(0).alias("predicted"), "toxicity.n_hits", "toxicity.n_words")
