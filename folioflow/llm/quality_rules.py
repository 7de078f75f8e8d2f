"""Quality rules: base statistics of each text and a learned decision list over them.

Statistics are computed from whole texts. Sequential covering learns ordered rules from labelled statistics: a rule is a
conjunction of threshold tests, grown greedily on two thirds of the rows by FOIL's gain and pruned on the other third;
rows it covers go, and the next rule is learned on the rest. Rules are emitted as one ordered Spark conditional
expression. A text that no rule rejects is kept.

Nulls and empty texts have zero statistics. Ratios with nothing to divide by are 0. Repeated rows are rows of their own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.labels import labelled_sample
from folioflow.llm.words import byte_list
from folioflow.session import Scratch, ship

_CONTINUATION = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_STOPS = b".,;:"
_SHOUTS = b"!?"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What rules may test.
FEATURES = ("n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "stop_rate", "shout_rate", "distinct_rate", "longest_word")
_SCHEMA = "struct<" + ",".join(f"{c}:bigint" for c in BASE) + "," + ",".join(f"{c}:double" for c in FEATURES[1:]) + ">"


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, end = Counter(windows), 0, 0
    for k, window in enumerate(windows):
        if counts[window] > 1:
            covered += k + 3 - max(end, k)
            end = k + 3
    return covered


def statistics(text: bytes | None) -> tuple:
    """The base statistics, then the features after ``n_words``."""
    text = text or b""
    words = text.split()
    n, joined = len(words), b"".join(words)
    chars = len(joined.translate(None, _CONTINUATION))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    seen, lines, dup = set(), 0, 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
    repeats = repeated_words(words)
    size, per = len(joined) or 1, n or 1
    rate = lambda chars: (len(joined) - len(joined.translate(None, chars)))
    return (
        n, chars, symbols, dup, repeats,
        chars / per, symbols / per, dup / (lines or 1), repeats / per, rate(_UPPER) / size, rate(_DIGITS) / size,
        rate(_STOPS) / per, rate(_SHOUTS) / per, len(set(words)) / per, float(max(map(len, words), default=0)),
    )


def _statistics_udf():
    names = [*BASE, *FEATURES[1:]]
    kinds = [pa.int64()] * len(BASE) + [pa.float64()] * (len(FEATURES) - 1)

    @F.arrow_udf(_SCHEMA)
    def text_statistics(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            columns = list(zip(*map(statistics, byte_list(texts)))) or [()] * len(names)
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return text_statistics.asNondeterministic()


@dataclass
class DecisionList:
    """Ordered rules; each is a list of (feature, "<=" or ">", threshold), and the first that holds rejects."""

    rules: list[list[tuple[str, str, float]]] = field(default_factory=list)

    def keeps(self) -> Column:
        """True unless a rule holds, as an ordered conditional expression."""
        out = None
        for rule in self.rules:
            test = F.lit(True)
            for name, op, t in rule:
                test = test & (F.col(name) <= t if op == "<=" else F.col(name) > t)
            out = F.when(test, False) if out is None else out.when(test, False)
        return F.lit(True) if out is None else out.otherwise(True)

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(f"{n} {op} {t:.6g}" for n, op, t in rule) for rule in self.rules) or "keep all"


def _holds(x: np.ndarray, rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, op, t in rule:
        out &= x[:, k] <= t if op == "<=" else x[:, k] > t
    return out


def learn(x: np.ndarray, bad: np.ndarray, names: tuple[str, ...], *, max_rules: int = 16, max_tests: int = 4, cuts: int = 64, precision: float = 0.9, least: int = 3, seed: int = 7) -> DecisionList:
    """Sequential covering. ``x``: a row of features for each labelled text; ``bad``: the class that rules cover."""
    order = np.random.default_rng(seed).permutation(len(x))
    grow, prune = order[: 2 * len(x) // 3], order[2 * len(x) // 3 :]
    gx, gy, px, py = x[grow], bad[grow], x[prune], bad[prune]
    rules = []
    while len(rules) < max_rules and gy.sum() >= least:
        rule, inside = [], np.ones(len(gx), bool)
        while len(rule) < max_tests and (~gy[inside]).any():
            best, p0, n0 = None, gy[inside].sum(), (~gy[inside]).sum()
            for k in range(x.shape[1]):
                values = np.unique(gx[inside, k])
                if len(values) < 2:
                    continue
                middles = (values[1:] + values[:-1]) / 2
                if len(middles) > cuts:
                    middles = middles[np.linspace(0, len(middles) - 1, cuts).astype(int)]
                for t in middles:
                    for op in ("<=", ">"):
                        held = inside & (gx[:, k] <= t if op == "<=" else gx[:, k] > t)
                        p, n = gy[held].sum(), (~gy[held]).sum()
                        if p < least:
                            continue
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if best is None or gain > best[0] + 1e-12:
                            best = (gain, k, op, float(t), held)
            if best is None or best[0] <= 0:
                break
            rule.append(best[1:4])
            inside = best[4]
        if not rule:
            break
        worth = []
        for keep in range(1, len(rule) + 1):
            held = _holds(px, rule[:keep])
            p, n = py[held].sum(), (~py[held]).sum()
            worth.append(((p - n) / (p + n) if p + n else -1.0, -keep))
        rule = rule[: -max(worth)[1]]
        held_g, held_p = _holds(gx, rule), _holds(px, rule)
        p, n = gy[held_g].sum() + py[held_p].sum(), (~gy[held_g]).sum() + (~py[held_p]).sum()
        if p < least or p / (p + n) < precision:
            break
        rules.append([(names[k], op, t) for k, op, t in rule])
        gx, gy, px, py = gx[~held_g], gy[~held_g], px[~held_p], py[~held_p]
    return DecisionList(rules)


def measure(docs: DataFrame, text_col: str = "text", out_col: str = "statistics") -> DataFrame:
    """``docs`` with a struct of the base statistics and the features."""
    ship(docs.sparkSession)
    return docs.withColumn(out_col, _statistics_udf()(F.col(text_col).cast("string")))


def apply_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", fit_rows: int = 20_000, min_words: int = 50, max_repeat_percent: int = 50) -> tuple[DataFrame, DecisionList]:
    """Statistics and verdict of each row, and the list that gave it.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat_percent`` of them in repeated windows.
    The list learns from at most about ``fit_rows`` labelled texts that pass the base rules; labels of the fold with
    remainder 1 are left out.
    """
    scratch = Scratch(docs.sparkSession)
    rows = measure(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), "_text", "_s")
    rows = rows.select("doc_id", "_s.*")
    rows = rows.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    rows = scratch.table("statistics", rows)
    fit = labelled_sample(rows, labels, label, fit_rows=fit_rows).where("NOT base_failed").select(*FEATURES, "_label").toArrow()
    x = np.column_stack([fit.column(c).to_numpy().astype(float) for c in FEATURES]) if fit.num_rows else np.zeros((0, len(FEATURES)))
    rules = learn(x, fit.column("_label").to_numpy() == 0, FEATURES)
    kept = F.when(F.col("base_failed"), False).otherwise(rules.keeps())
    return rows.select("doc_id", *BASE, "base_failed", kept.alias("kept"), *FEATURES[1:]), rules
