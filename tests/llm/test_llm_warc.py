import gzip
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sigbg.llm import capture_index, warc

SCHEMA = "page_id long, url string, html string"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=12), max_size=9))
def test_loser_tree_merges_runs(runs):
    runs = [sorted(x) for x in runs if x]
    keys = [v for x in runs for v in x]
    run = [i for i, x in enumerate(runs) for _ in x]
    order = capture_index.merge_order(keys, run)
    assert sorted(order) == list(range(len(keys)))
    assert [(keys[i], run[i], i) for i in order] == sorted((keys[i], run[i], i) for i in range(len(keys)))


def test_url_keys():
    assert warc.url_key("http://www.Example.com/A?q=1") == "com,example)/a?q=1" == warc.url_key("https://example.com:443/A?q=1")
    assert warc.url_key("http://example.com:8080") == "com,example:8080)/"
    assert warc.url_key(None) == warc.url_key("") == "" and warc.url_key("http://[bad") == "http://[bad"


def pages():
    same, body = "<p>" + "same payload " * 20 + "</p>", "é" * 60
    rows = [(i, f"http://site{i % 4}.example/p{i % 7}", f"<p>page {i} " + "w " * (i % 90) + "</p>") for i in range(120)]
    rows += [(1000 - i, "http://hot.example/", same) for i in range(60)]
    rows += [(2, "http://a.example/\r\nWARC-Type: x", same[:-1]), (3001, None, same[:-1]), (3002, "", ""), (3003, "u", None),
             (3004, "u", "x" * 99), (3005, "u", "x" * 99), (3006, "u", body), (3007, "u", body), (3008, "u", "a\r\n\r\nWARC/1.1\r\n\r\n\0" * 9),
             (None, "n", same), (None, "n", body + "!"), (None, "n", body + "!"), (3009, "r", body + "?"), (3009, "r", body + "?"),
             (3010, "big", "0123456789" * 30_000), (3010, "other", "y" * 200)]
    random.Random(1).shuffle(rows)
    return rows


def expected(rows):
    first = {}
    for p, _, h in rows:
        d = (h or "").encode()
        first.setdefault(d, []).append(p)
    out = []
    for p, _, h in rows:
        d = (h or "").encode()
        real = [x for x in first[d] if x is not None]
        low = min(real) if real else None
        rev = len(d) >= 100 and low is not None and p != low
        out.append((p, len(d), hashlib.sha256(d).hexdigest(), "revisit" if rev else "response", low if rev else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [warc.ARCHIVE_BYTES, 2000])
def test_archives_and_index(spark, tmp_path, monkeypatch, size):
    from pyspark.sql import functions as F
    monkeypatch.setattr(capture_index, "RANGE_ROWS", 40)
    rows = pages()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for c in ("digest", "first", "n", "run", "pos", "refers_to", "image"):
        df = df.withColumn(c, F.lit("x"))
    path = str(tmp_path / "warc")
    warc.write_archives(df, path, size=size)
    index = capture_index.merge_runs(warc.capture_runs(spark, path), rows=40).cache()
    got = index.collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)
    order = [(r.url_key, r.date, r.page_id is None, r.page_id or 0) for r in sorted(got, key=lambda r: (r.range, r.place))]
    assert order == sorted(order) and len({r.range for r in got}) > 1
    for r in got:                                                    # a record by its offset; whole files by any gzip reader
        with open(r.run.removeprefix("file:"), "rb") as f:
            f.seek(r.offset)
            x = warc.parse(gzip.decompress(f.read(r.length)))
        assert x["page_id"] == r.page_id and x["record_type"] == r.record_type
        if r.record_type == "response":
            assert hashlib.sha256(x["payload"]).hexdigest() == r.payload_digest
    assert all(gzip.decompress(open(f, "rb").read()).startswith(b"WARC/1.1\r\n") for f in {r.run.removeprefix("file:") for r in got})


def test_damage_is_found():
    raw = warc.record(1, "u", b"p" * 200, hashlib.sha256(b"p" * 200).hexdigest(), None, warc.CAPTURED)
    image = warc.member(raw) + warc.member(raw)
    assert [x["page_id"] for x in map(warc.parse, (r for *_, r in warc.members(image + b"\0")))] == [1, 1]
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"pppp\r\n\r\n", b"pppq\r\n\r\n"))
    with pytest.raises(ValueError):
        list(warc.members(image[:-9]))


def test_empty_pages(spark):
    assert warc.archive(spark.createDataFrame([], SCHEMA)).count() == 0
