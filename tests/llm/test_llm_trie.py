import hashlib
import random
import zlib

import pytest
from helpers import words_of

from sigbg.llm import burst_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuild(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            digest = hashlib.md5(f"{len(r)}:{r}{x}".encode()).digest()
            own.setdefault(c, []).append((t is not None, t or 0, digest, r, x))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + v[h:]
    return out


def plain(rows):
    """Brute force: every prefix of every rebuilt conversation."""
    convs = rebuild(rows)
    nodes = {}
    for c, v in convs.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def below(p):
        own = (len(nodes[p]) - 1) * (len(words_of(p[-1][1])) if p else 0)
        sub = [below(k) for k in kids.get(p, [])]
        return (sum(a for a, _ in sub) or 1, own + sum(b for _, b in sub))

    out = []
    for p, who in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in who if len(convs[c]) == len(p)))
        out.append((min(who), len(p), min(nodes[p[:-1]]) if p else None, len(who), len(kids.get(p, [])), *below(p),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def table(n=300, seed=3):
    """Common first turns, a conversation that a third of all ids hold, prefixes of others, nulls, ties and repeats."""
    r = random.Random(seed)
    rows = []
    for c in range(n):
        if c % 3 == 0:
            turns = [("user", "hello there"), ("assistant", "hi, how are you"), ("user", "well")]
        else:
            turns = [(r.choice(("user", "assistant")), r.choice(("hello there", "a b c", "one", "two words", ""))) for _ in range(r.randrange(1, 6))]
        rows += [(c, i, a, b) for i, (a, b) in enumerate(turns)]
    rows += [(1001, None, "user", "null turn first"), (1001, 0, None, None), (1001, 0, "user", "tie"), (1001, 0, "user", "tie"),
             (-23, 0, "user", "below"), (-23, 1, "user", "zero"), (None, 0, "user", "nobody's"), (2005, 0, "user", " ".join(["long"] * 50_000)),
             (2006, 0, "user", "x")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [burst_trie.LIMIT, 8, 1])
def test_trie_equals_brute_force(spark, limit):
    from pyspark.sql import functions as F
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for c in ("turns", "ids", "words", "head", "path", "seq", "n", "ends"):
        df = df.withColumn(c, F.lit("x"))
    got = burst_trie.conversation_trie(df, limit)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_sweep_needs_the_open_path_only():
    s = burst_trie.Sweep()
    ids = [bytes([i % 251, i // 251]) for i in range(5000)]
    s.add(b"", [], 0, 0, 5, 1, "e1", ids[:4000], [1] * 4000)
    s.add(b"", [], 0, 0, 3, 2, "e2", ids, [1] * 5000)
    s.finish()
    got = s.batch().to_pylist()
    top = next(x for x in got if x["depth"] == 0)
    assert len(got) == 5001 and (top["n_convs"], top["n_leaves"], top["conv_id"]) == (3, 1, 3)
    assert top["saved_tokens"] == 4000 * 2 + 1000 and sum(x["ends_sha256"] in ("e1", "e2") for x in got) == 2


def test_empty_and_turnless(spark):
    assert burst_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(c, 0, "user", "one turn") for c in range(21, 40)]        # base 20 is absent: most have no turn left
    got = burst_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_hashed_list_of_many_chunks(spark):
    from pyspark.sql import functions as F
    members = spark.range(5000).select(F.lit("s").alias("seq"), (F.col("id") * 3 - 4000).alias("conv_id"))
    want = hashlib.sha256(",".join(str(i * 3 - 4000) for i in range(5000)).encode()).hexdigest()
    assert [tuple(r) for r in burst_trie.ends_digests(members).collect()] == [("s", want)]
