import corpus_pipeline
import pytest
from helpers import CLASHING, edge_docs, lower_az, shingles, words_of

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_registered():
    q = entry.queries()
    numbers = {n.split("_")[0] for n in q if n.startswith("op")}
    assert numbers == {f"op{i}" for i in range(1, 14)} and "pipeline" in q
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mix", "pack"]


def test_stages_one_after_another(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        nxt = spark.read.parquet(str(tmp_path / name))
        if name != "pack":
            assert nxt.columns == docs.columns and nxt.count() > 0
        seen[name] = nxt
        docs = nxt
    texts = [r.text for r in seen["exact_dedup"].collect()]
    assert len({lower_az(t) for t in texts}) == len(texts)
    sets = [shingles(r.text, 5) for r in seen["near_dedup"].collect()]
    at = {}
    for i, s in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        common = {}
        for x in s:
            for j in at[x]:
                common[j] = common.get(j, 0) + (j < i)
        assert all(100 * n < 80 * (len(s) + len(sets[j]) - n) for j, n in common.items() if n)
    before = sum(len(words_of(r.text)) for r in seen["near_dedup"].collect())
    after = sum(len(words_of(r.text)) for r in seen["mix"].collect())
    assert abs(after - 1.5 * before) < 0.15 * before
    assert sum(r.length for r in seen["pack"].collect()) > after


@pytest.mark.parametrize("at", range(5))
def test_stages_take_odd_tables(spark, tmp_path, at):
    from pyspark.sql import functions as F
    name, stage = corpus_pipeline.STAGES[at]
    docs = edge_docs(spark).select("*", *[F.lit(1).alias(c) for c in CLASHING])
    out = stage(spark, docs, SF)
    if name != "pack":
        assert out.columns == docs.columns
    out.write.parquet(str(tmp_path / "x"))
    assert stage(spark, docs.limit(0), SF).count() == 0
