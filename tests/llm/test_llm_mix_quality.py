import random
from collections import Counter

import pytest
from helpers import SCHEMA, edge_docs, edge_rows, invented, with_clashes, words_of

from sigbg.llm import queries, quality_lm, systematic_mix


def fill(sizes, share=1.5, cap=2.0, weights=(3, 1, 2)):
    """Targets by resharing the excess until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        full = {s for s in open_ if left * w[s] / total >= cap * sizes[s]}
        if not full:
            return target | {s: left * w[s] / total for s in open_}
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def sized_rows(n, sources, seed=0):
    r = random.Random(seed)
    return [(i, " ".join(["w"] * int(r.paretovariate(1.2) * 10)), "en", r.choice(sources), 1) for i in range(n)]


@pytest.mark.parametrize("sources", [["a"] * 6 + ["b", "c", None], ["x"], list("abcdefg") + ["a"] * 10])
def test_targets_and_words_taken(spark, sources):
    rows = sized_rows(3000, sources)
    got = systematic_mix.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    size, n = Counter(), {d: len(words_of(t)) for d, t, *_ in rows}
    for d, t, _, s, _ in rows:
        size[s] += n[d]
    want, taken, by = fill(size), Counter(), {d: s for d, _, _, s, _ in rows}
    for r in got:
        assert r.size == n[r.doc_id] and abs(r.target - want[by[r.doc_id]]) < 1e-6 * r.target and r.source_size == size[by[r.doc_id]]
        assert 0 <= r.copies <= 2 and r.taken == r.size * r.copies
        taken[by[r.doc_id]] += r.taken
    for s in size:
        assert abs(taken[s] - want[s]) <= max(n[d] for d in n if by[d] == s)      # never off by more than one document


def test_mix_does_not_depend_on_partitioning_or_blocks(spark, monkeypatch):
    rows = sized_rows(1500, ["a", "a", "b"])
    a = systematic_mix.mix(spark.createDataFrame(rows, SCHEMA).repartition(2)).select("doc_id", "taken").collect()
    monkeypatch.setattr(systematic_mix, "BLOCK_ROWS", 20)
    b = systematic_mix.mix(spark.createDataFrame(rows, SCHEMA).repartition(9)).select("doc_id", "taken").collect()
    assert {r.doc_id: r.taken for r in a} == {r.doc_id: r.taken for r in b}


def test_mix_edge_cases(spark):
    got = systematic_mix.mix(with_clashes(edge_docs(spark))).collect()
    assert len(got) == len(edge_rows()) and all(r.taken <= 2 * r.size for r in got)
    assert {r.size for r in got if r.doc_id in (3, 4, 5)} == {0}
    assert systematic_mix.mix(edge_docs(spark).limit(0)).count() == 0


def test_mix_equals_sql(spark):
    from oracle_util import compare, duck
    sf = "/root/testdata/sf0.001"
    ok, msg = compare(queries.QUERIES["op8_systematic_mix"](spark, sf).toPandas(), duck(queries.ORACLE["op8_systematic_mix"], sf))
    assert ok, msg


# --- quality model -----------------------------------------------------------------------------

def plain_kneser_ney(counts):
    """Probability function of a code, from {code: trusted count}, by the textbook recursion."""
    levels, c = [], Counter({k: n for k, n in counts.items() if n})
    for order in range(quality_lm.ORDER, 0, -1):
        levels.append((order, c))
        c = Counter(k & ((1 << quality_lm.BITS * (order - 1)) - 1) for k in c)
    model = {}
    for order, c in levels:
        n = Counter(min(v, 5) for v in c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        d = [min(max(k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5 * k, 0.1), k - 0.05) for k in (1, 2, 3)]
        ctx = {}
        for k, v in c.items():
            t = ctx.setdefault(k >> quality_lm.BITS, [0, 0.0])
            t[0] += v
            t[1] += d[min(v, 3) - 1]
        model[order] = (c, d, ctx)

    def p(code, order=quality_lm.ORDER):
        if order == 0:
            return 1 / quality_lm.SYMBOLS
        g = code & ((1 << quality_lm.BITS * order) - 1)
        c, d, ctx = model[order]
        low = p(code, order - 1)
        t = ctx.get(g >> quality_lm.BITS)
        if t is None:
            return low
        n = c.get(g, 0)
        return (max(n - d[min(n, 3) - 1], 0) / t[0] if n else 0) + t[1] / t[0] * low

    return p


def test_model_matches_the_recursion_and_sums_to_one(spark, monkeypatch):
    import math
    monkeypatch.setattr(quality_lm, "SYMBOLS", 512)                 # every symbol below is under 512
    texts = [invented(80, i, 200).encode() for i in range(30)] + [b"ABC 123 !!!", "été à".encode()]
    counts = Counter(c for t in texts[:25] for code in quality_lm.ngram_codes(t) for c in code.tolist())
    all_ = set(counts) | {c for t in texts for code in quality_lm.ngram_codes(t) for c in code.tolist()}
    b = quality_lm.BITS
    some = [c >> b << b for c in sorted(all_)[:3]] + [31 << 3 * b | 30 << 2 * b | 29 << b]     # contexts, the last unseen
    for c in some:
        all_ |= {c | w for w in range(512)}
    df = spark.createDataFrame([(c, counts[c]) for c in all_], "code long, n long")
    got = {r.code: r.logp for r in quality_lm.kneser_ney(df).collect()}
    p = plain_kneser_ney(counts)
    assert set(got) == all_ and all(abs(got[c] - math.log(p(c))) < 1e-9 for c in all_)
    for c in some:
        assert abs(sum(math.exp(got[c | w]) for w in range(512)) - 1) < 1e-9


def test_codes_at_every_cut(monkeypatch):
    texts = ["", "ab", "Été 12, the end.", "жизнь 人工智能 \U0001f600", "x" * 40]

    def plain(t):
        s, b = [0, 0, 0, *[int(quality_lm.SYMBOL[ord(c)]) for c in t]], quality_lm.BITS
        return [s[i - 3] << 3 * b | s[i - 2] << 2 * b | s[i - 1] << b | s[i] for i in range(3, len(s))]

    for size in (1, 2, 3, 5, 7, 1000):
        monkeypatch.setattr(quality_lm, "CHUNK", size)
        for t in texts:
            assert [c for code in quality_lm.ngram_codes(t.encode()) for c in code.tolist()] == plain(t)
        assert list(quality_lm.ngram_codes(None)) == [] and sum(len(c) for c in quality_lm.ngram_codes(b"a\xff\xfeb")) == 4
    assert 0 <= quality_lm.SYMBOL.min() and quality_lm.SYMBOL.max() < quality_lm.SYMBOLS


def plain_judgement(rows, good_ids):
    """Scores and decisions by dictionaries: model of one half, quantiles of the trusted documents."""
    import math

    def codes(t):
        return [c for code in quality_lm.ngram_codes((t or "").encode()) for c in code.tolist()]

    counts = Counter(c for d, t, *_ in rows if good_ids.get(d) for c in codes(t))
    p = plain_kneser_ney(counts)
    nll = {d: (-sum(math.log(p(c)) for c in codes(t)), len(codes(t))) for d, t, *_ in rows}
    means = {}
    for lang in {r[2] for r in rows}:
        mine = [nll[r[0]] for r in rows if r[2] == lang and r[0] in good_ids]
        means[lang] = sum(a for a, _ in mine) / sum(n for _, n in mine)
    score = {r[0]: (nll[r[0]][0] + quality_lm.PRIOR * means[r[2]]) / (nll[r[0]][1] + quality_lm.PRIOR) for r in rows}
    kept = {}
    for lang in means:
        mine = sorted((score[r[0]], good_ids[r[0]]) for r in rows if r[2] == lang and r[0] in good_ids)
        both, fresh = [s for s, _ in mine], [s for s, seen in mine if not seen]

        def q(v, share):
            return v[max(0, math.ceil(share * len(v)) - 1)]

        lower = q(both, 0.002) - 0.05 - 2 * (q(both, 0.5) - q(both, 0.002)) / len(both) ** 0.5
        upper = q(fresh, 0.998) + 0.05 + 2 * (q(fresh, 0.998) - q(fresh, 0.5)) / len(fresh) ** 0.5
        kept |= {r[0]: lower <= score[r[0]] <= upper for r in rows if r[2] == lang}
    return score, kept


def test_scores_and_limits_match_brute_force_over_many_blocks(spark, monkeypatch):
    from pyspark.sql import functions as F
    monkeypatch.setattr(quality_lm, "BLOCK", 20_000)
    good, bad = quality_rows()
    rows = good[:120] + bad[:30]
    ids = [d for d, *_ in good[:60]]
    half = spark.createDataFrame([(d,) for d in ids], "doc_id long").select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("s"))
    score, kept = plain_judgement(rows, {r.doc_id: r.s for r in half.collect()})
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = quality_lm.classify(docs, spark.createDataFrame([(d, 1, 0) for d in ids], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows) and all(abs(r.score - score[r.doc_id]) < 1e-9 and r.kept == kept[r.doc_id] for r in got)
    assert quality_lm.Blocks(docs).table.select("b").distinct().count() > 3


def test_gibberish_of_other_scripts_is_rejected(spark):
    """Fluent-looking words of a fixed vocabulary against random letters of the same script, mixed languages."""
    r = random.Random(5)
    ru = ["жизнь", "человек", "время", "работа", "дорога", "история", "вопрос", "город", "слово", "друг", "новая", "большой", "через", "после"]
    zh = ["我们", "今天", "工作", "时间", "问题", "学习", "中国", "城市", "历史", "生活", "朋友", "可以", "没有", "这个"]
    rows, bad = [], []
    for i in range(120):
        rows.append((i, " ".join(r.choice(ru) for _ in range(60)), "ru", "s", 1))
        rows.append((1000 + i, "".join(r.choice(zh) for _ in range(90)), "zh", "s", 1))
    for i in range(40):
        bad.append((2000 + i, " ".join("".join(r.choice("бвгджзклмнпрстфхцчшщ") for _ in range(6)) for _ in range(60)), "ru", "s", 1))
        bad.append((3000 + i, "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(180)), "zh", "s", 1))
    labels = spark.createDataFrame([(d, 1, 0) for d, *_ in rows if d % 1000 < 60], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.kept for x in quality_lm.classify(spark.createDataFrame(rows + bad, SCHEMA), labels).collect()}
    assert sum(got[d] for d, *_ in rows) >= len(rows) - 3 and not any(got[d] for d, *_ in bad)


def quality_rows():
    good = [(i, (invented(120, i, 500) + ". ").capitalize(), "en" if i % 2 else "de", "s", 1) for i in range(300)]
    r = random.Random(1)
    bad = [(1000 + i, " ".join(r.choice(["###", "%%%", "AB1Z", "$$&&", "Q!!"]) + str(r.randrange(99)) for _ in range(80)), "en", "s", 1)
           for i in range(60)]
    return good, bad


def test_classifier_rejects_junk_and_keeps_clean(spark):
    good, bad = quality_rows()
    labels = spark.createDataFrame([(d, 1, 0) for d, *_ in good[:150]] + [(d, 0, 0) for d, *_ in bad[:10]], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(good + bad, SCHEMA)
    got = {r.doc_id: r for r in quality_lm.classify(docs, labels).collect()}
    assert sum(got[d].kept for d, *_ in good[150:]) >= 148 and not any(got[d].kept for d, *_ in bad)
    kept = quality_lm.keep(with_clashes(docs), labels)
    assert kept.columns == with_clashes(docs).columns and {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if r.kept}


def test_classifier_edge_cases(spark):
    schema = "doc_id long, quality int, toxic int"
    docs = with_clashes(edge_docs(spark))
    none = quality_lm.classify(docs, spark.createDataFrame([], schema)).collect()
    assert len(none) == len(edge_rows()) and all(r.kept == (r.n_symbols > 0) for r in none)
    odd = spark.createDataFrame([(1, 1, None), (1, 1, 0), (2, None, 0), (None, 1, 0), (10, 0, 0), (8, 1, 1)], schema)
    assert {r.doc_id for r in quality_lm.trusted_ids(odd).collect()} == {1}
    got = quality_lm.classify(docs, odd).collect()
    assert len(got) == len(edge_rows()) and all((r.perplexity is None) == (r.n_symbols == 0) for r in got)
    assert quality_lm.classify(docs.limit(0), odd).count() == 0
