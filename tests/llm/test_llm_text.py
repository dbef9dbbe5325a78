import hashlib
import random
import re

import pytest
from helpers import SCHEMA, edge_docs, edge_rows, invented, lower_az, with_clashes, words_of

from sigbg.llm import chunk_dedup, html_text, license_scan, spot_signatures


# --- HTML --------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tree(spark):
    return html_text.train_tree(spark)


def test_tree_fits_its_table(tree):
    rows = html_text.labelled_blocks()
    wrong = [b for b in rows if html_text.is_main(b, tree) != (b["y"] == "1")]
    assert len(rows) > 300 and len(wrong) <= 0.02 * len(rows)


def test_tree_on_held_out_lengths(spark, tree, monkeypatch):
    monkeypatch.setattr(html_text, "SCALES", (0.45, 0.8, 1.3, 2.0, 3.1))
    rows = html_text.labelled_blocks()
    wrong = [b for b in rows if html_text.is_main(b, tree) != (b["y"] == "1")]
    assert len(wrong) <= 0.05 * len(rows)


PAGE = """<!DOCTYPE html><html><head><title>Not this</title><style>p{}</style><script>var t="</p>";</script></head><body>
<div class="topnav"><a href="/">Home</a> <a href="/x">News</a></div><div id="cookie-banner"><p>We use cookies on this site to make it work.</p>
<button>Accept</button></div><article><header><h1>A &lt;headline&gt; &amp; more</h1></header><p>First   paragraph with <b>bold</b> and a
<a href="/l">link</a> in it.<p>Short.<p>Third&nbsp;one &eacute;t&#233; &#x41;.<br>After the break.
<aside><p>A pull quote from the side.</p></aside><form><label>Mail</label><input name=q><p>Sign up for our letter today please.</p></form>
<ul><li>point one<li>point two</ul><div class="comment-list"><div class="comment"><p>I liked this article very much indeed, thanks!</p></div></div>
</article><aside class="sidebar"><h3>Related</h3><p>Another long story that you may want to read next on this site.</p></aside>
<footer>&copy; 2024 All of us</footer><p class=cut"""


def test_page_with_everything(spark, tree):
    want = "\n".join(["A <headline> & more", "First paragraph with bold and a link in it.", "Short.",
                      "Third one été A. After the break.", "point one", "point two"])
    pages = spark.createDataFrame([(1, "u", PAGE)], "page_id long, url string, html string")
    r = html_text.extract(pages, tree).first()
    assert r.text == want and r.n_chars == len(want)


def test_page_edge_cases(spark, tree):
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<p>"), (3, "w", "plain text " * 30), (3, "w", "plain text " * 30),
            (4, "x", "<article>" + "<p>word</p>" * 5000 + "</article>"), (5, "y", "<a <b <<< & &amp &#xD800; <!-- open"),
            (6, "z", "<article><p>" + "<div>" * 3000 + "deep words here"), (7, "q", '<article><p title="a > b">kept text</p></article>')]
    df = with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = html_text.extract(df, tree).collect()
    assert len(got) == len(rows)
    by = {(r.page_id, r.url): r for r in got}
    assert by[(1, "u")].text == "" and by[(2, None)].n_chars == 0 and by[(None, "v")].text == ""
    assert by[(4, "x")].text == "\n".join(["word"] * 5000) and by[(6, "z")].text == "deep words here" and by[(7, "q")].text == "kept text"
    assert html_text.extract(df.limit(0), tree).count() == 0


def test_classes_of_wrappers_speak_against_nothing(tree):
    words = lambda n: " ".join(["word"] * n)
    article = f"<h1>{words(6)}</h1><p>{words(50)}.</p><p>{words(3)}.</p><p>{words(40)}.</p>"
    side = f'<div class="comments"><article class="comment"><p>{words(31)}.</p></article></div><div class="sidebar"><p>{words(29)}.</p></div>'
    for before, after in (("<html class='has-menu'><body class='single has-sidebar'><article>", "</article>"),
                          ("<body><div id='page' class='site has-footer'><main>", "</main></div>"),
                          ("<body><article class='post comments-open'>", "</article>"),
                          ("<body class='search'><div class='site has-footer'><div class='content'>", f"{side}</div></div>"),
                          ("<body><form class='share tags'><article>", "</article></form>")):
        for more in ("", side):
            found = html_text.blocks(before + article + after + more + "</body>")
            main = [b["words"] for b in found if html_text.is_main(b, tree)]
            assert main == [6, 50, 3, 40], (before, more, main)


def _prose(n, name="prose"):
    return " ".join(f"{name}{i % 23}" for i in range(n)) + "."


ARTICLE = [_prose(n, f"t{n}x") for n in (57, 83, 11, 66, 74)]
P = [f"<p>{t}</p>" for t in ARTICLE]
NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News today</a></li></ul></nav>'
FOOT = "<footer><p>All rights kept by us</p></footer>"
NAMED_PAGES = {
    "widgets of a page builder": NAV + '<div class="elementor">' + "".join(
        f'<div class="elementor-widget elementor-widget-text-editor"><div class="elementor-widget-container">{p}</div></div>' for p in P) + "</div>" + FOOT,
    "widgets in an article": NAV + "<article>" + "".join(f'<div class="elementor-widget">{p}</div>' for p in P) + "</article>" + FOOT,
    "a section on side effects": f'{NAV}<article>{P[0]}<section class="side-effects">{"".join(P[1:4])}</section>{P[4]}</article>{FOOT}',
    "a section on related work": f'{NAV}<main>{P[0]}{P[1]}<section id="related-work">{"".join(P[2:])}</section></main>{FOOT}',
    "a last paragraph after links": f'{NAV}<article>{"".join(P[:4])}<ul>' + "".join(f'<li><a href="/{i}">link number {i}</a></li>' for i in range(3)) + f"</ul>{P[4]}</article>{FOOT}",
    "comments under responses": f'{NAV}<article>{"".join(P)}</article><div class="responses"><h3>Answers</h3><p>{_prose(44, "no")}</p><p>{_prose(71, "no")}</p></div>{FOOT}',
    "responses inside the article": f'{NAV}<article>{"".join(P)}<section id="responses"><p>{_prose(38, "no")}</p><p>{_prose(29, "no")}</p></section></article>{FOOT}',
    "an unmarked cookie box": f'<div><p>{_prose(21, "no")}</p><button>Accept all</button><button>No</button></div>{NAV}<article>{"".join(P)}</article>{FOOT}',
    "an unmarked cookie box, no main tag": f'{NAV}<div><h1>t9 t9 t9 t9</h1>{"".join(P)}</div><div><p>{_prose(19, "no")}</p><button>Accept</button></div>{FOOT}',
    "compound side names": f'<div class="site-header"><p>{_prose(6, "no")}</p></div><article>{"".join(P)}<div class="newsletter-signup"><p>{_prose(14, "no")}</p></div></article>'
                           f'<div class="sidebar-left"><p>{_prose(22, "no")}</p></div><div id="comment-list"><p>{_prose(48, "no")}</p></div><div class="site-footer"><p>{_prose(9, "no")}</p></div>',
}


@pytest.mark.parametrize("case", NAMED_PAGES)
def test_density_decides_beside_names(case, tree):
    main = [b["text"] for b in html_text.blocks(f"<html><body>{NAMED_PAGES[case]}</body></html>") if html_text.is_main(b, tree)]
    wanted = [t for t in main if t in ARTICLE]
    assert wanted == ARTICLE
    assert not [t for t in main if t.startswith("no") or "rights" in t or t == "Home"]


def test_heading_ids_are_link_targets(tree):
    page = f'<body>{NAV}<article><h1 id="search">Looking for things</h1>{P[0]}<h2 id="share-prices">What shares cost</h2>{P[1]}</article></body>'
    assert [b["text"] for b in html_text.blocks(page) if html_text.is_main(b, tree)] == ["Looking for things", ARTICLE[0], "What shares cost", ARTICLE[1]]


def test_the_tree_asks_for_words(tree):
    asked = {html_text.FEATURES[node[0]] for node in tree if node[0] >= 0}
    counts = {"words", "prose_near", "words_before", "words_after", "box_words"}
    density = counts | {"links", "links_before", "links_after", "box_links", "box_share"}
    assert len(asked & counts) >= 3 and len(asked & density) >= 6
    assert html_text.FEATURES[tree[0][0]] not in ("side_tags", "side_names", "talk_names")


def test_deep_nesting_is_linear():
    deep = '<div class="ad">' * 20000 + "<p>a b c</p>" + "</div>" * 20000
    assert [b["text"] for b in html_text.blocks(deep)] == ["a b c"]



# --- chunks ------------------------------------------------------------------------------------

def test_gear_hash_depends_on_the_window_only():
    import numpy as np
    rng = random.Random(3)
    tail = bytes(rng.randrange(256) for _ in range(40))
    a, b = (chunk_dedup.gear_hashes(np.frombuffer(h + tail, dtype=np.uint8)) for h in (b"x" * 50, b"completely other"))
    assert (a[-25:] == b[-25:]).all()
    h = 0
    for c in tail:
        h = (2 * h + int(chunk_dedup.GEAR[c])) % (1 << chunk_dedup.WINDOW)
    assert int(a[-1]) == h


def test_insertion_disturbs_only_what_it_touches():
    text = invented(2000, 5, 5000)
    w = text.split()
    other = " ".join(w[:1000] + ["inserted"] + w[1000:])
    _, a = chunk_dedup.chunks_of(text.encode())
    _, b = chunk_dedup.chunks_of(other.encode())
    assert len(set(a) - set(b)) < 0.05 * len(a) and len(a) > 300


def test_passages_are_found_and_clean_texts_left_alone(spark):
    r, rows, holders = random.Random(4), [], {}
    for i in range(200):
        w = invented(r.randrange(60, 400), 100 + i, 9000).split()
        if i < 60:
            p = invented(r.randrange(55, 90), 50_000 + i % 20, 9000).split()
            at = r.randrange(len(w))
            w[at:at] = p
            holders[i] = p
        rows.append((i, ("common line of eight words at the top\n" if i % 2 else "") + " ".join(w), "en", "s", 1))
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = chunk_dedup.passages(df).collect()
    assert {x.doc_id for x in got} == set(holders)
    for x in got:
        found = " ".join(words_of(lower_az(rows[x.doc_id][1]))[x.start_word:x.start_word + x.n_words])
        assert found in " ".join(holders[x.doc_id])
        assert x.kept == (x.doc_id < 20) and x.first_doc_id == x.doc_id % 20
    left = {x.doc_id: x.text for x in chunk_dedup.remove_passages(df, chunk_dedup.passages(df)).collect()}
    assert all(left[i] == rows[i][1] for i in range(200) if i < 20 or i >= 60)
    assert all(len(left[i]) < len(rows[i][1]) for i in range(20, 60))


def test_no_passage_of_51_words_is_lost():
    r, lost = random.Random(9), 0
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 9)))
    for i in range(6000):
        p = [word() for _ in range(51)] if i % 2 else sum(([word()] * r.randint(1, 30) for _ in range(51)), [])[:51]
        found = []
        for _ in range(2):
            before = [word() for _ in range(r.randint(0, 12))]
            place, digest = chunk_dedup.chunks_of(" ".join(before + p + [word() for _ in range(r.randint(0, 12))]).encode())
            found.append({d: (int(a) - len(before), int(b) - len(before)) for d, (a, b) in zip(digest, place.tolist())})
        both = [found[0][d] for d in set(found[0]) & set(found[1])]
        lost += not both or max(b for _, b in both) - min(a for a, _ in both) < chunk_dedup.MIN_PASSAGE
    assert lost == 0


def test_every_chunk_survives_in_its_first_document(spark):
    text = lambda n, seed: invented(n, seed, 9000)
    a, b, c = text(60, 70_001), text(80, 70_002), text(70, 70_003)
    rows = [(1, f"{text(50, 1)} {a} {text(50, 2)}"), (5, f"{text(50, 3)} {a} {b} {text(50, 4)}"), (7, f"{text(50, 5)} {a} {b} {c}"),
            (8, f"{c} {a} {text(50, 6)}"), (9, f"{text(50, 3)} {a} {b} {text(50, 4)}")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    got = chunk_dedup.passages(df)
    left = {x.doc_id: x.text for x in chunk_dedup.remove_passages(df, got).collect()}
    assert left[1] == rows[0][1] and len(left[9].split()) < 40
    for passage, holder in ((a, 1), (b, 5), (c, 7)):
        assert passage in left[holder]
        middle = " ".join(passage.split()[25:-25])
        assert [i for i in left if middle in left[i]] == [holder]
    firsts = {(x.doc_id, x.kept): x.first_doc_id for x in got.collect()}
    assert firsts[5, True] == 5 and firsts[5, False] == 1 and firsts[7, True] == 7


def test_passages_edge_cases(spark):
    got = chunk_dedup.passages(with_clashes(edge_docs(spark))).collect()
    assert {x.doc_id for x in got} == {6, 7} and max(x.n_words for x in got) >= 29_990
    assert chunk_dedup.passages(edge_docs(spark).limit(0)).count() == 0
    same = spark.createDataFrame([(1, invented(100), "en", "s", 1)] * 3, SCHEMA)
    assert chunk_dedup.passages(same).count() == 0                  # copies of one id don't repeat each other


# --- licences ----------------------------------------------------------------------------------

def test_every_template_is_recognised_and_has_a_cue(spark):
    cue = re.compile(license_scan.CUE)
    assert all(cue.search(t) for _, t in license_scan.TEMPLATES)
    df = spark.createDataFrame([(t,) for _, t in license_scan.TEMPLATES], "seg string")
    got = {r.seg: r for r in license_scan.sentence_licences(df).collect()}
    assert all(got[t].license == lic and got[t].score > 0.999 for lic, t in license_scan.TEMPLATES)


def test_cosine_matches_plain_python(spark):
    import math
    from collections import Counter
    bags = [(lic, Counter(re.findall(license_scan.WORD, t.lower()))) for lic, t in license_scan.TEMPLATES]
    df = Counter(w for _, b in bags for w in b)
    idf = lambda w: math.log((1 + len(bags)) / (1 + df[w])) + 1 if w in df else math.log(1 + len(bags)) + 1
    segs = ["Released under the MIT License, see file.", "This code is licensed under Apache 2.0 or later", "license license other words"]
    got = {r.seg: r for r in license_scan.sentence_licences(spark.createDataFrame([(s,) for s in segs], "seg string")).collect()}
    for s in segs:
        v = Counter(re.findall(license_scan.WORD, s.lower()))
        cos = [sum(n * b[w] * idf(w) ** 2 for w, n in v.items()) / math.sqrt(sum((n * idf(w)) ** 2 for w, n in v.items()))
               / math.sqrt(sum((n * idf(w)) ** 2 for w, n in b.items())) for _, b in bags]
        assert abs(got[s].score - max(cos)) < 1e-9 and got[s].license == bags[cos.index(max(cos))][0]


def test_inheritance_from_the_nearest_ancestor(spark):
    rows = [("LICENSE", "Released under the MIT License."), ("a/b/COPYING", "Licensed under the Apache License, Version 2.0."),
            ("a/x.py", "code"), ("a/b/c/d/y.py", "code"), ("a/b/z.py", "# Licensed under CC BY-NC 4.0.\ncode " * 2), ("top.py", None),
            (None, "no path"), ("other/q.py", "the licence of nothing in particular")]
    df = spark.createDataFrame([(i, i, p, t) for i, (p, t) in enumerate(rows)], "k_id long, k_hash long, path string, text string")
    got = {r.path: r for r in license_scan.scan(df).collect()}
    assert got["a/x.py"].license == "MIT" and got["a/x.py"].from_dir == "" and got["top.py"].license == "MIT"
    assert got["a/b/c/d/y.py"].license == "Apache-2.0" and got["a/b/c/d/y.py"].from_dir == "a/b"
    assert got["a/b/z.py"].license == "CC-BY-NC-4.0" and got["a/b/z.py"].from_dir is None
    assert got["other/q.py"].own_license is None and got["other/q.py"].score < license_scan.THRESHOLD and got[""].license == "MIT"


def test_wrapped_headers_tags_and_whole_licences(spark):
    from sigbg.llm import license_texts
    whole = dict(license_texts.headers()[-7:])
    gpl = ("This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\n"
           "the Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.\n\n"
           "This program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\n"
           "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details.\n")
    apache = ('Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\n'
              "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n")
    hashed = lambda t: "".join(f"# {x}\n" for x in t.splitlines())
    starred = lambda t: "/*\n" + "".join(f" * {x}\n" for x in t.splitlines()) + " */\n"
    code = "\nimport os\n\ndef f(x):\n    return x\n" * 20
    rows = [("a1/x.py", hashed(gpl) + code, "GPL-2.0"), ("a2/x.c", starred("Copyright 2020 A. Person\n\n" + gpl) + code, "GPL-2.0"),
            ("a3/x.c", starred(gpl.replace("version 2", "version 3")) + code, "GPL-3.0"), ("a4/x.py", gpl + code, "GPL-2.0"),
            ("a5/x.c", starred(gpl.replace("General", "Lesser General").replace("version 2", "version 2.1")) + code, "LGPL-2.1"),
            ("a6/x.go", hashed(apache).replace("#", "//") + code, "Apache-2.0"), ("a7/x.py", "# SPDX-License-Identifier: Apache-2.0" + code, "Apache-2.0"),
            ("a8/x.py", "SPDX-License-Identifier: MIT" + code, "MIT"), ("a9/x.c", "// SPDX-License-Identifier: GPL-2.0-or-later" + code, "GPL-2.0"),
            ("b1/x.c", "/* SPDX-License-Identifier: (GPL-2.0 WITH Linux-syscall-note) */" + code, "GPL-2.0"),
            ("b2/LICENSE", "GNU GENERAL PUBLIC LICENSE", None), ("b3/x.py", "# GNU GENERAL PUBLIC LICENSE" + code, None),
            ("b4/COPYING", whole["GPL-2.0"][:1500], "GPL-2.0"),
            ("b5/x.py", "# This work is licensed under the GNU General\n# Public License, version 3.\n" + code, "GPL-3.0")]
    rows += [(f"whole/{lic}/LICENSE", t, lic) for lic, t in whole.items()] + [(f"whole/{lic}/src/x.py", "code", lic) for lic in whole]
    df = spark.createDataFrame([(i, i, p, t) for i, (p, t, _) in enumerate(rows)], "k_id long, k_hash long, path string, text string")
    got = {r.path: r.license for r in license_scan.scan(df).collect()}
    assert got == {p: lic for p, _, lic in rows}


def test_license_edge_cases(spark):
    got = license_scan.scan_documents(with_clashes(edge_docs(spark))).collect()
    assert len(got) == len(edge_rows()) and all(r.license is None for r in got)
    assert license_scan.scan_documents(edge_docs(spark).limit(0)).count() == 0


# --- SpotSigs ----------------------------------------------------------------------------------

def edited(rows):
    """(id, text) in descending id -> edited texts, by the contract's words."""
    out = []
    for (d, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 2
        out.append((d, t[:len(t) - k] + nxt[:k]))
    return out


def test_fingerprints_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(spot_signatures, "BLOCK_ROWS", 7)
    rows = [(i * 37 % 1009, invented(1 + i * 7 % 60, i, 300) + (" the of and " * (i % 4)) + "é" * (i % 3)) for i in range(150)]
    rows[5] = (rows[5][0], rows[6][1])
    got = {r.doc_id: r for r in spot_signatures.fingerprints(spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], SCHEMA)).collect()}
    want = sorted(rows, reverse=True)
    text = dict(rows)
    for (d, e), (n, _) in zip(edited(want), want[1:] + want[:1]):
        assert got[d].edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and got[d].n_chars == len(text[d])
        parts = lambda s: {s[i:i + 8] for i in range(0, len(s), 8)}
        for value, other in ((got[d].near_next, got[n].fingerprint), (got[d].near_edited, got[d].edited_fingerprint)):
            x, y = parts(got[d].fingerprint), parts(other)
            assert abs(value - (len(x & y) / len(x | y) if x | y else 1.0)) < 1e-12
    assert got[rows[5][0]].fingerprint == got[rows[6][0]].fingerprint
    assert sum(r.near_edited for r in got.values()) > 3 * sum(r.near_next for r in got.values())


def test_fingerprint_edge_cases(spark):
    got = spot_signatures.fingerprints(with_clashes(edge_docs(spark))).collect()
    assert len(got) == len(edge_rows())
    assert {r.fingerprint for r in got if r.doc_id in (3, 4)} == {""}
    assert len({r.fingerprint for r in got if r.doc_id is None}) == 1
    assert spot_signatures.fingerprints(edge_docs(spark).limit(0)).count() == 0
    one = spot_signatures.fingerprints(spark.createDataFrame([(5, "ab cd", "en", "s", 1)], SCHEMA)).first()
    assert one.edited_sha256 == hashlib.sha256(b"ab ab").hexdigest()


def test_near_pairs_match_brute_force(spark):
    r, rows = random.Random(9), []
    for f in range(30):
        base = [("the" if r.random() < 0.4 else w) for w in invented(r.randrange(20, 150), f, 2000).split()]
        for _ in range(4):
            w = list(base)
            for _ in range(r.randrange(0, 3)):
                w[r.randrange(len(w))] = "edit%d" % r.randrange(1000)
            rows.append((len(rows), " ".join(w), "en", "s", 1))
    df = spark.createDataFrame(rows, SCHEMA)
    pairs, member = spot_signatures.near_pairs(df, 0.7)
    cls = {x.doc_id: x["class"] for x in member.collect()}
    fp = {x.doc_id: x.fp for x in spot_signatures.add_fingerprint(df, "text", "fp").select("doc_id", "fp").collect()}
    sets = {cls[d]: frozenset(s) for d, s in fp.items()}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    assert {(x.a, x.b) for x in pairs.collect()} == want and len(want) > 10
