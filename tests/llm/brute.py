"""Plain Python versions of the operators' results."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter


def words(text):
    return (text or "").encode("utf-8", "surrogatepass").split()


def fold(doc_id, modulus):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def base_statistics(text):
    w, text = words(text), text or ""
    triples = Counter(zip(w, w[1:], w[2:]))
    covered = {k + j for k, t in enumerate(zip(w, w[1:], w[2:])) if triples[t] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(len(x.decode("utf-8", "surrogatepass")) for x in w), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def shingle_set(text):
    w = [x.lower() for x in words(text)]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def jaccard_components(rows):
    """rows of (id, text) -> list of (n_shingles, component) in order."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    shared = Counter()
    for group in where.values():
        for k, i in enumerate(group):
            for j in group[k + 1 :]:
                shared[i, j] += 1
    for (i, j), n in shared.items():
        if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
            parent[find(j)] = find(i)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            smallest[find(i)] = min(doc_id, smallest.get(find(i), doc_id))
    return [(len(s), smallest.get(find(i)) if s else rows[i][0]) for i, s in enumerate(sets)]


def jaccard_links(texts):
    """(other sets linked, other texts linked) of each, by all pairs."""
    sets = [shingle_set(t) for t in texts]
    like = [[t for t in sets if s and 100 * len(s & t) >= 80 * len(s | t)] for s in sets]
    return [(len(set(x)) - bool(s), len(x) - bool(s)) for s, x in zip(sets, like)]


def repeats(texts, window=35):
    """n_words, n_removed, kept text of each."""
    ws = [words(t) for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in ws for i in range(len(w) - window + 1))
    out = []
    for w in ws:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((len(w), len(gone), kept))
    return out


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def unigram_scores(rows):
    """rows of (id, text) -> (held_out, n_tokens, n_known, train_tokens, base_score)."""
    tokens = [[x.lower() for x in words(t)] + [None] for _, t in rows]
    counts = Counter(t for (i, _), ts in zip(rows, tokens) if fold(i, 7) != 2 for t in ts)
    n, v = sum(counts.values()), len(counts)
    return [(fold(i, 7) == 2, len(ts), sum(counts[t] > 0 for t in ts), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts)) for (i, _), ts in zip(rows, tokens)]


def grid(p, step=1024):
    """The next value of the logarithmic grid not above p."""
    return 10 ** (-math.ceil(-math.log10(p) * step - 1e-9) / step)


def model_probability(rows, order, rounded=lambda p: p):
    """p(context, word) by absolute discounting, interpolated with the context one word shorter, over all n-grams of the
    training texts; and the events that have a probability of their own. ``rounded``: what is stored of a probability."""
    counts, after = Counter(), {}
    for i, t in rows:
        if fold(i, 7) != 2:
            w = [b"<s>", *(x.lower() for x in words(t)), b"</s>"]
            for gram in (tuple(w[k - n : k + 1]) for k in range(1, len(w)) for n in range(min(order, k + 1))):
                counts[gram] += 1
                after.setdefault(gram[:-1], set()).add(gram[-1])
    single = [counts[w,] for w in after[()]]
    total, once, twice = sum(single), single.count(1), single.count(2)
    d = min(0.9, max(0.05, once / max(1, once + 2 * twice)))
    followed = {c: sum(counts[*c, x] for x in words) for c, words in after.items()}
    stored = {g: rounded((n - d) / followed[g[:-1]]) for g, n in counts.items() if len(g) > 1}
    left = {c: 1 - sum(stored[*c, x] for x in words) for c, words in after.items() if c}

    def p(context, word):
        if not context:
            return (counts[word,] - d if counts[word,] else d * len(single)) / total
        shorter = p(context[1:], word)
        return stored.get((*context, word), 0) + rounded(left[context]) * shorter if context in left else shorter

    return p, sorted(after[()])


def model_scores(rows, order, rounded=grid):
    """id -> log10 probability of the text."""
    p, _ = model_probability(rows, order, rounded)
    texts = {i: [b"<s>", *(x.lower() for x in words(t)), b"</s>"] for i, t in rows}
    return {i: sum(math.log10(p(tuple(w[max(0, k - order + 1) : k]), w[k])) for k in range(1, len(w))) for i, w in texts.items()}
