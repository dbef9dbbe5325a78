"""Fixtures and plain Python versions that the operators are held against."""

from __future__ import annotations

import hashlib
import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall(text or "")


def lower_az(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def invented(n, seed=0, vocabulary=400):
    """n invented words."""
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnoprstuvwz") for _ in range(1 + v % 9))
                    for v in (r.randrange(vocabulary) * 7919 % 5003 for _ in range(n)))


def edge_rows():
    """Nulls in every column, empty, blank, very long and repeated texts, ties, equal texts up to case."""
    long_ = invented(30_000, 3, 5000)
    return [
        (1, "The quick brown fox jumps over the lazy dog near the bank of the river.", "en", "a", 10),
        (2, "the quick brown fox jumps over the lazy dog near the bank of the river.", "en", "a", 10),
        (3, None, "en", "a", None), (4, "", "en", None, 0), (5, " \t\n ", None, "b", 4),
        (6, long_, "en", "b", 1), (7, long_ + " tail", "en", "b", 1), (8, "Éa É", "fr", "c", 4), (9, "éa é", "fr", "c", 4),
        (10, "one two", "en", "c", 7), (11, "ONE TWO", "en", "c", 7), (12, "!!!", "xx", "d", 3),
        (12, "!!!", "xx", "d", 3), (12, "???", "xx", "d", 3), (None, "a row without id", "en", "d", 16),
        (None, "a row without id", "en", "d", 16), (13, "x\x1cy z 　 é İstanbul ΑΣ ǅ 中文 don't <|endoftext|> 12.5%", "en", "d", 9),
    ]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


#: Names that operators use inside or return, as extra columns of the input.
CLASHING = ("k_id", "k_hash", "row", "t", "key", "kept", "keep_id", "size", "copies", "block", "cid", "n", "label", "score",
            "digest", "path", "c0", "k_n", "shard", "run", "mean", "words")


def with_clashes(df):
    from pyspark.sql import functions as F
    return df.select("*", *[F.lit(f"x{c}").alias(c) for c in CLASHING])


def shingles(text, k):
    w = lower_az(text)
    w = words_of(w)
    if not w:
        return frozenset()
    if len(w) < k:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def near_components(rows, k, percent):
    """doc position -> smallest linked position's id, over (id, text) rows with distinct ids."""
    sets = [shingles(t, k) for _, t in rows]
    at = {}
    for i, s in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(i)
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for i, s in enumerate(sets):
        common = {}
        for x in s:
            for j in at[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                top[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d: low[find(i)] for i, (d, _) in enumerate(rows)}, {d: len(sets[i]) for i, (d, _) in enumerate(rows)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
