"""Quality classifier: attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE`` words. Every passage is encoded from its words: each word and each word's shape
has one of ``WORDS`` and ``SHAPES`` hashed embeddings, learned with the network, whose sum, with the passage's character and
count statistics, goes through a tanh layer. Gated attention (tanh and sigmoid branches) weighs the passages; the weighted sum goes through a
logistic unit. All weights are learned from document labels alone, by Adam on the log loss, on a bounded sample of
labelled texts; whole texts are scored. The network is small, so numpy trains it on the driver.

A null or empty text is a bag of one passage without words. A very long text has as many passages as it needs. Repeated rows
are rows of their own, and ties don't arise: each text is scored by itself. An empty table gives an empty result, and with
labels of one class only, or none, every text gets the same score. Other columns are passed through by ``score``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.labels import labelled_sample
from folioflow.llm.words import MEMOS, byte_list, fold, keep_only
from folioflow.session import ship

PASSAGE = 50
_CLASSES = (bytes(range(65, 91)), b"0123456789", b".,;:", b"!?", b"#*$%&|<>", b"()[]{}'\"-_/\\@+=~^`", bytes(range(0x80, 0x100)))
STATS, WORDS, SHAPES = len(_CLASSES) + 9, 256, 64
WIDTH = STATS + WORDS + SHAPES
_SHAPE = bytes(0x30 if 48 <= b < 58 else 0x41 if 65 <= b < 91 else 0x61 if 97 <= b < 123 else 0x75 if b > 127 else b for b in range(256))


class _Codes(dict):
    """Word to the numbers of its embedding and of its shape's, in one. Starts over when it holds many words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        if len(word) > 1 and word.isalpha() and word.islower():
            shape = b"aa"
        else:
            shape = re.sub(rb"(.)\1{2,}", rb"\1\1", word[:64].translate(_SHAPE), flags=re.S)
        value = self[word] = xxhash.xxh3_64_intdigest(word) % WORDS | xxhash.xxh3_64_intdigest(shape) % SHAPES << 16
        return value


CODES = _Codes()
MEMOS.append(CODES)


def encode(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """A text's passages: the statistics of each, and the code of each word."""
    words = (text or b"").split()
    out = []
    for at in range(0, len(words) or 1, PASSAGE):
        part = words[at : at + PASSAGE]
        n, joined = len(part) or 1, b" ".join(part)
        size = len(joined) or 1
        distinct = len(set(part))
        lengths = [*map(len, part)]
        first = part[0] if part else b""
        out.append((
            *((len(joined) - len(joined.translate(None, c))) / size * 10 for c in _CLASSES),
            len(part) / PASSAGE,
            size / n / 6,
            distinct / n,
            part.count(first) / n,
            max(lengths, default=0) / 20,
            lengths.count(1) / n * 5,
            len(set(zip(part, part[1:]))) / n,
            sum(map(bytes.isupper, part)) / n,
            sum(map(bytes.istitle, part)) / n,
        ))
    return np.array(out, np.float32), np.fromiter(map(CODES.__getitem__, words), np.uint32, len(words))


def dense(stats: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The passages of a text as rows: statistics, then how often each word and shape embedding is summed."""
    n, width = len(stats), WORDS + SHAPES
    at = np.arange(len(codes)) // PASSAGE * width
    bags = np.bincount(np.r_[at + (codes & 0xFFFF), at + WORDS + (codes >> 16)].astype(np.int64), minlength=n * width).reshape(n, width)
    return np.hstack([stats, bags.astype(np.float32) / np.float32(PASSAGE**0.5)])


def passages(text: bytes | None) -> np.ndarray:
    """The encoded passages of a text."""
    return dense(*encode(text))


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, starts: np.ndarray):
        """Scores of bags that start at ``starts`` in the passage matrix ``x``; and what the gradient needs."""
        w = self.w
        h = np.tanh(x @ w["enc"] + w["enc_b"])
        t, s = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-np.clip(h @ w["u"], -30, 30)))
        e = (t * s) @ w["a"]
        bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        att = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(h * att[:, None], starts)
        p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["c_b"], -30, 30)))
        return p, (h, t, s, bag, att, z)

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x[:, :STATS] - self.mean) / self.scale, -6, 6), x[:, STATS:]]).astype(np.float32)

    def score(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return self.forward(self.standard(x), starts)[0] if len(starts) else np.empty(0)


def train(x: np.ndarray, starts: np.ndarray, y: np.ndarray, *, hidden: int = 16, gate: int = 8, steps: int = 500, bags: int = 512, rate: float = 0.02, decay: float = 1e-4, seed: int = 3) -> Network:
    """Adam on the class-weighted log loss, ``bags`` at a time."""
    rng = np.random.default_rng(seed)
    stats = x[:, :STATS]
    net = Network(stats.mean(0) if len(x) else np.zeros(STATS), stats.std(0) + 1e-3 if len(x) else np.ones(STATS), {
        "enc": np.vstack([rng.normal(0, 0.3, (STATS, hidden)), rng.normal(0, 0.05, (WORDS + SHAPES, hidden))]), "enc_b": np.zeros(hidden), "v": rng.normal(0, 0.3, (hidden, gate)), "u": rng.normal(0, 0.3, (hidden, gate)),
        "a": rng.normal(0, 0.3, gate), "c": rng.normal(0, 0.3, hidden), "c_b": np.zeros(1),
    })
    good = float(y.sum())
    if not len(y) or good in (0, len(y)):
        net.w["c_b"][:] = 4.0 if not len(y) or good else -4.0  # one class only, or none: keep what nothing speaks against
        net.w["c"][:] = 0
        return net
    net.w = {k: a.astype(np.float32) for k, a in net.w.items()}
    all_x, all_y, lengths = net.standard(x), y, np.diff(np.append(starts, len(x)))
    all_weight = np.where(y == 1, 0.5 / good, 0.5 / (len(y) - good)) * max(1, len(y) / bags)
    m, v = ({k: np.zeros_like(a) for k, a in net.w.items()} for _ in range(2))
    first, waiting = starts, np.empty(0, int)
    for step in range(1, steps + 1):
        if not len(waiting):
            waiting = rng.permutation(len(all_y))
        some, waiting = np.sort(waiting[:bags]), waiting[bags:]
        starts = np.cumsum(np.r_[0, lengths[some][:-1]])
        x, y, weight = all_x[np.repeat(first[some] - starts, lengths[some]) + np.arange(lengths[some].sum())], all_y[some], all_weight[some]
        p, (h, t, s, bag, att, z) = net.forward(x, starts)
        w, dz_ = net.w, ((p - y) * weight).astype(np.float32)
        g = {"c": z.T @ dz_, "c_b": np.array([dz_.sum()])}
        dz = (dz_[:, None] * w["c"])[bag]
        dh = att[:, None] * dz
        datt = (dz * h).sum(1)
        de = att * (datt - np.add.reduceat(att * datt, starts)[bag])
        g["a"] = (t * s).T @ de
        dts = de[:, None] * w["a"]
        dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
        g["v"], g["u"] = h.T @ dt, h.T @ ds
        dh += dt @ w["v"].T + ds @ w["u"].T
        dpre = dh * (1 - h * h)
        g["enc"], g["enc_b"] = x.T @ dpre, dpre.sum(0)
        for k in w:
            grad = g[k] + decay * w[k]
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad * grad
            w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return net


def _encoded_udf():
    @F.arrow_udf("struct<stats:binary,codes:binary>")
    def encoded_passages(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [encode(t) for t in byte_list(texts)]
            yield pa.StructArray.from_arrays([pa.array([s.tobytes() for s, _ in found], pa.binary()), pa.array([c.tobytes() for _, c in found], pa.binary())], names=["stats", "codes"])

    return encoded_passages


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", fit_rows: int = 4_000, **how) -> Network:
    """A network from about ``fit_rows`` labelled texts at most; labels of the fold with remainder 1 are left out."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    rows = labelled_sample(rows, labels, label, fit_rows=fit_rows, id_col="_id").select("_id", "_label", _encoded_udf()("_text").alias("x")).select("_id", "_label", "x.*").toArrow().sort_by([("_id", "ascending"), ("stats", "ascending"), ("codes", "ascending")])
    bags = [dense(np.frombuffer(s, np.float32).reshape(-1, STATS), np.frombuffer(c, np.uint32)) for s, c in zip(rows.column("stats").to_pylist(), rows.column("codes").to_pylist())]
    starts = np.cumsum([0, *map(len, bags)])[:-1].astype(int) if bags else np.empty(0, int)
    return train(np.concatenate(bags) if bags else np.zeros((0, WIDTH), np.float32), starts, rows.column("_label").to_numpy().astype(float), **how)


def score(docs: DataFrame, network: Network, *, text_col: str = "text", out_col: str = "quality_score") -> DataFrame:
    """``docs`` with each whole text's score in ``out_col``."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(network)  # a few kilobytes

    @F.arrow_udf("double")
    def bag_score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            keep_only(CODES)
            scores, bags, held = [], [], 0
            for text in [*byte_list(texts), False]:  # the last stands for the end
                if text is not False:
                    bags.append(passages(text))
                    held += len(bags[-1])
                if bags and (held > 4_000 or text is False):
                    scores.append(shared.value.score(np.concatenate(bags), np.cumsum([0, *map(len, bags)])[:-1]))
                    bags, held = [], 0
            yield pa.array(np.concatenate(scores) if scores else np.empty(0), pa.float64())

    return docs.withColumn(out_col, bag_score.asNondeterministic()(F.col(text_col).cast("string")))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **how) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    network = fit(docs, labels, id_col=id_col, text_col=text_col, **how)
    rows = score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), network, out_col="score")
    return rows.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
