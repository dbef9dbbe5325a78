import random

import numpy as np
import pytest
from helpers import CLASHING, SCHEMA, edge_docs, edge_rows, invented, lower_az, near_components, sha, with_clashes

from sigbg.llm import components, cuckoo_dedup, near_dedup
from sigbg.llm.common import restrict
from sigbg.llm.shingles import Shingler, Signer, mix64


# --- cuckoo filter and exact dedup -------------------------------------------------------------

def test_filter_inserts_deletes_and_overflows():
    keys = [sha(str(i)) for i in range(5000)]
    s = cuckoo_dedup.Shard()
    for i, k in enumerate(keys):
        assert s.add(k, i)
    assert s.resizes > 0 and all(s.filter.contains(k) for k in keys)
    assert not s.add(keys[0], 9000) and s.keys[keys[0]] == [9000, 2, 1]
    for k in keys[:2500]:
        assert s.remove(k)
    assert not s.remove(keys[0])
    assert all(s.filter.contains(k) for k in keys[2500:])          # deletions never lose a live key
    wrong = sum(s.filter.contains(sha(f"other{i}")) for i in range(20000))
    assert wrong < 20                                               # 8 slots of 16 bits
    back = cuckoo_dedup.CuckooFilter.from_bytes(s.filter.to_bytes())
    assert all(back.contains(k) for k in keys[2500:])


def test_false_hit_is_verified():
    s, key = cuckoo_dedup.Shard(), sha("a")
    s.add(key, 1)
    twin = "f" * 8 + key[8:28] + "0" * 36                           # same print and buckets, another key
    assert s.filter.contains(twin) and s.add(twin, 2) and s.false_hits == 1
    assert not s.remove("e" * 8 + key[8:28] + "0" * 36)


def expected_exact(rows):
    ids = {}
    for d, t, *_ in rows:
        ids.setdefault(sha(lower_az(t)), []).append(d)
    return ids


def test_exact_dedup_edge_cases(spark):
    rows = edge_rows()
    got = cuckoo_dedup.dedup(with_clashes(edge_docs(spark))).collect()
    groups = expected_exact(rows)
    assert len(got) == len(rows)
    for r in got:
        ids = groups[r.text_sha256]
        real = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == (max(real) if real else None)
    for k in groups:
        assert sum(r.kept for r in got if r.text_sha256 == k) == 1
    assert cuckoo_dedup.dedup(edge_docs(spark).limit(0)).count() == 0


def test_exact_dedup_hot_group(spark):
    rows = [(i, "hot" if i % 3 else f"t{i // 6}", "en", "s", 1) for i in range(6000)]
    got = cuckoo_dedup.dedup(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    hot = [r for r in got if r.text_sha256 == sha("hot")]
    assert len(got) == 6000 and len(hot) == 4000 and {r.keep_id for r in hot} == {5999}
    assert sum(r.kept for r in got) == 1001 and all(r.group_size == 2 for r in got if r.text_sha256 != sha("hot"))


def test_index_batches(spark):
    df = lambda texts: spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    index = cuckoo_dedup.CuckooIndex(spark, n_shards=4)
    index.insert(df(["a", "b", "c"]))
    index.insert(df(["C", "d"]))
    index.delete(df(["b", "zz"]))
    found = {r.key: r.found for r in index.lookup(df(["a", "b", "c", "d", "e", "A"])).collect()}
    assert found == {sha("a"): True, sha("b"): False, sha("c"): True, sha("d"): True, sha("e"): False}


def test_index_counts_rows_and_reopens(spark, tmp_path):
    df = lambda texts: spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    path = str(tmp_path / "index")
    index = cuckoo_dedup.CuckooIndex(spark, n_shards=4, path=path)
    index.insert(df(["a", "A", "a", "b"]))
    index.delete(df(["a"]))
    again = cuckoo_dedup.CuckooIndex(spark, n_shards=9, path=path)
    assert (again.gen, again.n_shards) == (2, 4)
    probe = df(["a", "b"])
    assert {r.key: r.found for r in again.lookup(probe).collect()} == {sha("a"): True, sha("b"): True}
    again.delete(df(["a", "a", "b"]))
    assert not any(r.found for r in cuckoo_dedup.CuckooIndex(spark, path=path).lookup(probe).collect())
    spark.createDataFrame([], again.SCHEMA).write.parquet(f"{path}/gen=9")         # a generation that was never finished
    assert cuckoo_dedup.CuckooIndex(spark, path=path).gen == 3


def test_restrict_keeps_columns_and_counts(spark):
    from pyspark.sql import functions as F
    docs = with_clashes(edge_docs(spark))
    kept = cuckoo_dedup.dedup(docs).filter("kept")
    out = restrict(docs, kept.select("k_id", "k_hash", F.lit(2).alias("k_n")))
    assert out.columns == docs.columns and out.count() == 2 * len(expected_exact(edge_rows()))
    assert {r.kept for r in out.select("kept").collect()} == {"xkept"} and CLASHING


def test_restrict_returns_the_rows_asked_for(spark):
    """Rows of one id and text that differ elsewhere come out once each; more copies go round all of them."""
    from pyspark.sql import functions as F

    from sigbg.llm.common import row_key
    docs = spark.createDataFrame([(1, "same text", "en", "A", 9), (1, "same text", "en", "B", 9), (1, "same text", None, "A", 9),
                                  (2, "", "en", "A", 0), (2, None, "en", "A", 0), (3, "alone", "en", "C", 5)], SCHEMA)
    kid, kh = row_key(docs)

    def run(n):
        kept = docs.select(kid.alias("k_id"), kh.alias("k_hash")).distinct().withColumn("k_n", F.lit(n))
        return sorted((r.doc_id, str(r.text), str(r.lang), r.source) for r in restrict(docs, kept).collect())

    all_rows = sorted((r.doc_id, str(r.text), str(r.lang), r.source) for r in docs.collect())
    once = run(1)
    assert len(once) == 4 and set(once) <= set(all_rows) and once == run(1)
    two = run(2)
    assert len([r for r in two if r[0] == 1]) == 2 and len(set(r for r in two if r[0] == 1)) == 2
    assert [r for r in two if r[0] == 3] == [all_rows[-1]] * 2
    three = run(3)
    assert [r for r in three if r[0] == 1] == [r for r in all_rows if r[0] == 1]
    assert sorted(set(run(7))) == all_rows and len([r for r in run(7) if r[0] == 1]) == 7


# --- near dedup --------------------------------------------------------------------------------

def near_rows(seed=1, families=25):
    """Families of edited copies, one large family, exact copies and unrelated texts."""
    r, rows = random.Random(seed), []

    def edit(words, n):
        w = list(words)
        for _ in range(n):
            w[r.randrange(len(w))] = "edit%d" % r.randrange(10 ** 6)
        return " ".join(w)

    for f in range(families):
        base = invented(r.randrange(20, 200), seed * 1000 + f, 3000).split()
        for c in range(r.randrange(1, 6)):
            rows.append(edit(base, r.randrange(0, 1 + len(base) // 25)))
    base = invented(150, 77, 3000).split()
    rows += [edit(base, r.randrange(0, 9)) for _ in range(120)]    # some too far from the original, near to others
    rows += ["same text again and again"] * 40 + [invented(30, 5000 + i, 3000) for i in range(40)]
    r.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("k,percent,symbols,block", [(3, 85, 32, 512), (3, 85, 32, 20), (5, 80, 40, 512)])
def test_near_groups_match_brute_force(spark, k, percent, symbols, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)                # 20: the large family takes many blocks
    rows = near_rows()
    want, sizes = near_components(rows, k, percent)
    got = near_dedup.near_groups(spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], SCHEMA), k, percent, symbols).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_groups_edge_cases(spark):
    got = near_dedup.near_groups(with_clashes(edge_docs(spark)), 3, 85, 32).collect()
    assert len(got) == len(edge_rows())
    by = {(r.doc_id, r.n_shingles): r for r in got}
    assert by[(2, by_n(2))].component_id == 1 and by[(7, by_n(7))].component_id == 6
    assert all(r.component_id == r.doc_id and r.kept for r in got if r.n_shingles == 0)
    assert by[(11, 1)].component_id == 10
    assert near_dedup.near_groups(edge_docs(spark).limit(0)).count() == 0


def test_one_of_each_component_stays(spark):
    rows = edge_rows()
    r = near_dedup.representatives(near_dedup.near_groups(edge_docs(spark), 3, 85, 32)).collect()
    # 1/2, 6/7, 8, 9, 10/11, two kinds of 12, the row without id and 13; the three blank texts all stay.
    assert sum(x.k_n for x in r) == 12 and len([x for x in r if x.k_id == 12]) == 2 and rows


def by_n(doc_id):
    from helpers import shingles
    return next(len(shingles(t, 3)) for d, t, *_ in edge_rows() if d == doc_id)


def test_pigeonhole_finds_every_pair_within_radius(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 16, 32, dtype=np.uint16)
    rows = [(0, base.tobytes())]
    for i in range(1, 200):
        s = base.copy()
        at = rng.choice(32, 15, replace=False)
        s[at] ^= rng.integers(1, 1 << 16, 15, dtype=np.uint16)
        rows.append((i, s.tobytes()))
    entries = near_dedup.bucket_entries(spark.createDataFrame(rows, "cid long, sig binary"), 32, 4, 1).toPandas()
    mine = set(entries[entries.cid == 0].key)
    assert all(mine & set(g.key) for c, g in entries.groupby("cid"))


def test_shingler_and_signer():
    s = Shingler(3)
    assert len(s.shingles(b"A b C a B c")) == 3 and len(s.shingles(b"  ")) == 0 and len(s.shingles(b"x y")) == 1
    assert (s.shingles(b"A\tb\nc") == s.shingles(b"a b c")).all()
    x = mix64(np.arange(1, 1001, dtype=np.uint64))
    y = np.concatenate([x[:900], mix64(np.arange(5001, 5101, dtype=np.uint64))])
    d = np.mean(Signer(2000).sign(x) != Signer(2000).sign(y))
    assert abs(d - (1 - 900 / 1100)) < 0.03


def test_components_on_chains_stars_and_cliques(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + \
        [(a, b) for a in range(700, 712) for b in range(a + 1, 712)] + [(3, 3)]
    comp = {r.node: r.comp for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({comp[i] for i in range(100, 161)}) == 1 and len({comp[i] for i in range(500, 560)}) == 1
    assert len({comp[100], comp[500], comp[700]}) == 3 and 3 not in comp
