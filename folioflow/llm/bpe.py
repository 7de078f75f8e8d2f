"""BPE encoding and decoding through a tokenization automaton.

**Construction.** The automaton reads token sequences and accepts exactly those that byte-pair encoding produces. It
starts as one state with an arc for each byte. Each merge ``(u, v) -> t``, in rank order, applies one gadget: the state
``q`` that arcs ``u`` lead to is copied, the copy loses its arc ``v``, arcs ``u`` now lead to the copy, and wherever ``u``
could be read a new arc ``t`` leads to where ``v`` led from ``q``. All arcs of one label lead to one state throughout, so
the automaton is held copy on write: a state is its origin and the one arc it lost, and the transition test looks the
loss up in the gadget table instead of copying tens of thousands of arcs into each state.

**Encoding.** A text is cut at special tokens, then into words by the tokenizer's pattern. Each prefix of a word has one
accepted path, so one left-to-right pass over table lookups finds for every position the single arc that ends there.

**Decoding** emits the arcs' labels.

Nulls encode to no ids and decode to the empty text; ids outside the vocabulary emit nothing; bytes that are not UTF-8
decode to U+FFFD. Rows, row order within partitions and other columns are kept, repeated rows included.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.words import keep_only, pieces
from folioflow.session import ship

#: The byte-level pre-tokenizer's pattern, with white space as Unicode's White_Space property.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_NEVER = 1 << 60
_HELD = 150_000  # what a worker's memos hold before they start over
_PREFIX = 7  # bytes


def byte_alphabet() -> dict[str, int]:
    """The visible character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(shifted)}


class TokenizationAutomaton:
    """States, arcs and labels; see the module's text."""

    def __init__(self, byte_ids: dict[int, int], merges: list[tuple[int, int, int]], size: int):
        """``byte_ids``: byte to id. ``merges``: (left, right, merged) ids in rank order. ``size``: ids are below it."""
        self.labels = [b""] * size
        self.born, self.left, self.right = [0] * size, [-1] * size, [-1] * size
        self.state_after = [0] * size  # where arcs of this label lead
        self.origin, self.lost, self.made = [-1], [-1], [0]  # of each state: what it was copied from, the arc it lost, the step
        self.gadgets: dict[int, int] = {}  # left << 32 | right: the step at which arcs `left` lost a following `right`
        alive = [False] * size
        for byte, token in byte_ids.items():
            self.labels[token], alive[token] = bytes([byte]), True
        for step, (u, v, t) in enumerate(merges, 1):
            if self.left[t] >= 0 or alive[t]:
                raise ValueError(f"token {t} is the result of two merges")
            self.labels[t] = self.labels[u] + self.labels[v]
            if not (alive[u] and alive[v] and self.follows(u, v)):
                continue  # no accepted path reads u, v any more: the gadget changes nothing
            self.origin.append(self.state_after[u])
            self.lost.append(v)
            self.made.append(step)
            self.state_after[t] = self.state_after[v]
            self.state_after[u] = len(self.origin) - 1
            self.born[t], self.left[t], self.right[t], alive[t] = step, u, v, True
            self.gadgets[u << 32 | v] = step
        self.arcs = {self.labels[t]: t for t in range(size) if alive[t]}
        self.known: dict[int, bool] = {}  # pairs tested
        self.prefixes: dict[bytes, int] = {}  # the last arc of short prefixes, which words share
        self.ends: dict[bytes, int] | None = None

    def follows(self, a: int, b: int) -> bool:
        """Whether the state after an arc ``a`` has an arc ``b``.

        An arc born at a step exists where its left part did just then; the state of a merged label is the one its
        right part had just before. So the test walks both back through the steps until one gadget took the arc away
        or both are bytes, which follow each other in the first state.
        """
        before = _NEVER
        while True:
            if self.gadgets.get(a << 32 | b, _NEVER) < before:
                return False
            if self.born[a] > self.born[b]:
                before, a = min(before, self.born[a]), self.right[a]
            elif self.born[b]:
                before, b = min(before, self.born[b] + 1), self.left[b]
            else:
                return True

    def follows_by_states(self, a: int, b: int) -> bool:
        """The same by walking the copies themselves; slow, for tests."""
        state = self.state_after[a]
        while True:
            if self.born[b] and self.born[b] >= self.made[state]:
                b = self.left[b]
            elif state == 0:
                return True
            elif self.lost[state] == b:
                return False
            else:
                state = self.origin[state]

    def encode_word(self, word: bytes) -> list[int]:
        if (whole := self.arcs.get(word)) is not None:
            return [whole]
        known, prefixes, ends = self.known, self.prefixes, self._ends()
        n = len(word)
        last = [-1] * (n + 1)
        for end in range(1, n + 1):
            if end <= _PREFIX and (arc := prefixes.get(word[:end])) is not None:
                last[end] = arc
                continue
            found = []  # arcs that end here, short ones first
            start = end - 1
            while start >= 0 and (arc := ends.get(word[start:end])) is not None:
                if arc >= 0:
                    found.append((start, arc))
                start -= 1
            for start, arc in reversed(found):
                if start:
                    pair = last[start] << 32 | arc
                    fits = known.get(pair)
                    if fits is None:
                        if len(known) > _HELD:
                            known.clear()
                        fits = known[pair] = last[start] >= 0 and self.follows(last[start], arc)
                    if not fits:
                        continue
                last[end] = arc
                break
            if end <= _PREFIX:
                if len(prefixes) > _HELD:
                    prefixes.clear()
                prefixes[word[:end]] = last[end]
        out = []
        while n:
            arc = last[n]
            if arc < 0:
                raise ValueError("the vocabulary lacks a byte of the text")
            out.append(arc)
            n -= len(self.labels[arc])
        return out[::-1]

    def _ends(self) -> dict[bytes, int]:
        """Every end of a label: its arc, or -1 if it is no label itself."""
        if self.ends is None:
            self.ends = {label[k:]: -1 for label in self.arcs for k in range(1, len(label))} | self.arcs
        return self.ends

    def __getstate__(self):
        return self.__dict__ | {"ends": None, "known": {}, "prefixes": {}}


class _Encoded(dict):
    """Word to packed ids, in two generations: when the young one is full the old one goes and the young one grows old,
    so that words in use stay and memory is bounded. Long words are not held."""

    def __init__(self, automaton: TokenizationAutomaton, generation: int = 120_000):
        super().__init__()
        self.automaton, self.generation, self.old = automaton, generation, {}

    def __missing__(self, word: str) -> bytes:
        value = self.old.get(word)
        if value is None:
            value = array("I", self.automaton.encode_word(word.encode("utf-8", "surrogatepass"))).tobytes()
            if len(word) > 64:
                return value
        if len(self) >= self.generation:
            self.old = self.copy()
            self.clear()
        self[word] = value
        return value


class Tokenizer:
    """A byte-level BPE tokenizer read from a tokenizer JSON file."""

    def __init__(self, spec: dict):
        model = spec["model"]
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or model.get("ignore_merges") or model.get("byte_fallback"):
            raise ValueError("not a plain byte-level BPE tokenizer")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("special tokens that take in their surroundings are not supported")
        vocab, alphabet = model["vocab"], byte_alphabet()
        size = max([*vocab.values(), *(t["id"] for t in added)]) + 1
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = TokenizationAutomaton({b: vocab[c] for c, b in alphabet.items() if c in vocab}, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], size)
        self.emits = list(self.automaton.labels)
        self.special = {t["content"]: t["id"] for t in added}
        for text, token in self.special.items():
            self.emits[token] = text.encode()
        self._ready = None

    @classmethod
    def from_file(cls, path: str) -> "Tokenizer":
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def _parts(self):
        if self._ready is None:
            by_length = sorted(self.special, key=len, reverse=True)
            cut = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")") if by_length else None
            self._ready = regex.compile(WORD_PATTERN).findall, cut, _Encoded(self.automaton)
        return self._ready

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        words, cut, encoded = self._parts()
        if not text:
            return b""
        if cut is None or not any(s in text for s in self.special):
            return b"".join(map(encoded.__getitem__, words(text)))
        return b"".join(array("I", [self.special[part]]).tobytes() if k % 2 else b"".join(map(encoded.__getitem__, words(part))) for k, part in enumerate(cut.split(text)))

    def decode(self, ids: bytes | None) -> bytes:
        return emit(self.emits, ids)


def emit(labels: list[bytes], ids: bytes | None) -> bytes:
    """The labels of the ids' arcs, as UTF-8."""
    if not ids:
        return b""
    numbers, n = np.frombuffer(ids, "<u4"), len(labels)
    out = b"".join(map(labels.__getitem__, (numbers if numbers.max() < n else numbers[numbers < n]).tolist()))
    try:
        out.decode()
    except UnicodeDecodeError:
        return out.decode("utf-8", "replace").encode()
    return out


def _encoder(shared):
    @F.arrow_udf("binary")
    def encode_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        keep_only()
        encode = shared.value.encode
        for texts in pieces(batches):
            yield pa.array((encode(t.as_py()) for t in texts), pa.binary(), size=len(texts))

    return encode_text.asNondeterministic()


def _decoder(shared):
    @F.arrow_udf("string")
    def decode_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        labels = shared.value
        for ids in batches:
            yield pa.array((emit(labels, i.as_py()) for i in ids), pa.binary(), size=len(ids)).cast(pa.string())

    return decode_ids.asNondeterministic()


def _round_trip_udf(shared):
    @F.arrow_udf("struct<ids:binary,decoded:string>")
    def encode_and_decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        keep_only()
        encode, labels = shared.value.encode, shared.value.emits
        for texts in pieces(batches):
            ids = pa.array((encode(t.as_py()) for t in texts), pa.binary(), size=len(texts))
            decoded = pa.array((emit(labels, i.as_py()) for i in ids), pa.binary(), size=len(ids)).cast(pa.string())
            yield pa.StructArray.from_arrays([ids, decoded], names=["ids", "decoded"])

    return encode_and_decode.asNondeterministic()


def share(spark: SparkSession, tokenizer: Tokenizer | str):
    """Broadcast a tokenizer, for encoding, and its labels, for decoding; a string is the path of its file.

    Their size is that of the vocabulary.
    """
    ship(spark)
    whole = Tokenizer.from_file(tokenizer) if isinstance(tokenizer, str) else tokenizer
    return spark.sparkContext.broadcast(whole), spark.sparkContext.broadcast(whole.emits)


def encode(df: DataFrame, shared, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``df`` with the ids of ``text_col`` in ``out_col``, as packed little-endian unsigned 32-bit integers."""
    return df.withColumn(out_col, _encoder(shared[0])(F.col(text_col)))


def decode(df: DataFrame, shared, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids_col`` in ``out_col``."""
    return df.withColumn(out_col, _decoder(shared[1])(F.col(ids_col)))


def round_trip(docs: DataFrame, tokenizer: Tokenizer | str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row, from its encoded ids and its decoded text."""
    shared = share(docs.sparkSession, tokenizer)
    # one pass for both, so that ids need not travel to Python again
    rows = docs.select(F.col(id_col).alias("doc_id"), _round_trip_udf(shared[0])(F.col(text_col).cast("string")).alias("s")).select("doc_id", "s.*")
    return rows.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
