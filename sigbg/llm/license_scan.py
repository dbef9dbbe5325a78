"""Licence scan with directory inheritance (operator 6); DataFrame functions only.

Whole texts are cut into lines' sentences, and into blocks between blank lines
whose wrapped lines and comment marks are joined, and these into sentences;
those with a word that every template has one of are compared with the
templates by the cosine of sparse TF-IDF vectors: words join a table of template
weights, products are summed by sentence and template.  Blocks, and files named
like a licence file as a whole, are compared with standard headers and whole
licences in the same way.  SPDX tags say their licence themselves.  A file takes
the licence of its tag, else of its whole text, else of its best piece; a file that is named like
a licence file, or that consists mostly of licence sentences, also speaks for
its directory.  Files without a licence of their own take that of the nearest
ancestor directory that has one, found by joining directories with their
ancestors.  Equal sentences are scored once.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import write_through
from .common import NULL_ID, join_groups, row_key, text_of
from .license_texts import headers

#: Short notices by licence identifier.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may obtain a copy of the Apache License, Version 2.0 at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Released under the GPL version 3 license."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Released under the 3-clause BSD License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under this BSD license."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("ISC", "Released under the ISC License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."),
    ("CC0-1.0", "Released into the public domain under the CC0 1.0 license."),
    ("Unlicense", "This is free and unencumbered software released into the public domain (unlicense)."),
    ("Proprietary", "Copyright. All rights reserved."),
)
CUE = r"(?i)licen[cs]|copyright|public domain|hereby granted|\bgpl\b"
WORD = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
SENTENCE = r"[\n\r]+|(?<=[.!?])[\x20\t]+"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([.-][^/]*)?$"
BLANK = r"\r?\n[\x20\t]*(?:\r?\n[\x20\t]*)+"
WRAP = r"[\x20\t]*\r?\n[\x20\t]*(?:/?\*+/?|//+[!/]?|#+|;+|--+|%+)?[\x20\t]*"
SPDX_ID = r"\(*[A-Za-z0-9][A-Za-z0-9.+-]*\)*"
SPDX = rf"SPDX-License-Identifier:[\x20\t]*({SPDX_ID}(?:[\x20\t]+(?:OR|AND|WITH)[\x20\t]+{SPDX_ID})*)"
#: What a text must say besides to be taken for these licences.
NEEDS = (("LGPL", r"(?i)lesser|library|\blgpl"), ("AGPL", r"(?i)affero|\bagpl"), ("GPL-2", r"(?i)2|\btwo\b"), ("GPL-3", r"(?i)3|\bthree\b"))
LINE, BLOCK_SENTENCE, BLOCK, WHOLE, TAG = range(5)
THRESHOLD = 0.6
SHARE = 0.5


def template_weights(spark: SparkSession, templates=TEMPLATES) -> tuple[DataFrame, DataFrame, float]:
    """((word, idf), (word, template, license, weight), idf of unknown words); weights are of unit vectors."""
    bags = [(i, lic, Counter(re.findall(WORD, text.lower()))) for i, (lic, text) in enumerate(templates)]
    df = Counter(w for _, _, b in bags for w in b)
    idf = {w: math.log((1 + len(bags)) / (1 + n)) + 1 for w, n in df.items()}
    rows = []
    for i, lic, b in bags:
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in b.items()))
        rows += [(w, i, lic, n * idf[w] / norm) for w, n in b.items()]
    return (spark.createDataFrame(list(idf.items()), "word string, idf double"),
            spark.createDataFrame(rows, "word string, template int, license string, weight double"),
            math.log(1 + len(bags)) + 1)


def sentence_licences(sentences: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(seg, n_words, license, score): best template of each distinct ``seg`` string, with its cosine."""
    idf, weights, unknown = template_weights(sentences.sparkSession, templates)
    segs = sentences.select("seg").distinct().withColumn("id", F.xxhash64("seg"))       # a whole text stands for its words once
    words = segs.select("id", F.explode(F.regexp_extract_all(F.lower("seg"), F.lit(WORD), F.lit(0))).alias("word"))
    tf = words.groupBy("id", "word").agg(F.count(F.lit(1)).alias("tf"))
    vec = tf.join(F.broadcast(idf), "word", "left").withColumn("v", F.col("tf") * F.coalesce("idf", F.lit(unknown)))
    vec = write_through(vec.select("id", "word", "tf", "v"), "licence-vectors")
    norm = vec.groupBy("id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"), F.sum("tf").alias("n_words"))
    dot = vec.join(F.broadcast(weights), "word").groupBy("id", "template", "license").agg(F.sum(F.col("v") * F.col("weight")).alias("dot"))
    best = dot.groupBy("id").agg(F.max(F.struct("dot", -F.col("template"), "license")).alias("b"))
    return segs.join(best.join(norm, "id"), "id").select("seg", "n_words", F.col("b.license").alias("license"), (F.col("b.dot") / F.col("norm")).alias("score"))


def scan(files: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """One row per row of ``files(path, text)`` plus its identity (k_id, k_hash).

    k_id, k_hash, path, own_license, score (of the best sentence, null without
    a cue), n_licenses (distinct ones of its own), from_dir (directory that the
    licence was inherited from), license.  Null text counts as empty; a null
    path is a file at the root.  Repeated rows come out each.  Empty table:
    empty result.
    """
    files = files.select("k_id", "k_hash", F.coalesce("path", F.lit("")).alias("path"), text_of("text").alias("text")) \
        .withColumn("named", F.col("path").rlike(LICENCE_FILE))
    cued = lambda c: F.filter(c, lambda x: x.rlike(CUE))
    blocks = F.transform(cued(F.split("text", BLANK)), lambda x: F.regexp_replace(x, WRAP, " "))
    # A line's own sentences come out once; joined ones only where they aren't such.
    lines = cued(F.split("text", SENTENCE))
    joined = F.array_except(cued(F.flatten(F.transform(blocks, lambda x: F.split(x, SENTENCE)))), lines)
    whole = F.when(F.col("named"), F.array(F.col("text"))).otherwise(F.array().cast("array<string>"))
    tags = F.regexp_extract_all("text", F.lit(SPDX), F.lit(1))
    # The names of an expression, without what follows WITH, joiners and brackets.
    tags = F.flatten(F.transform(tags, lambda x: F.filter(F.split(F.regexp_replace(x, r"[\x20\t]WITH[\x20\t]+[^\x20\t]+|[()]", ""), r"[\x20\t]+"),
                                                          lambda y: ~y.isin("OR", "AND", ""))))
    of_kind = lambda k, c: F.transform(c, lambda x: F.struct(F.lit(k).alias("kind"), F.trim(x).alias("seg")))
    pieces = [of_kind(*x) for x in ((LINE, lines), (BLOCK_SENTENCE, joined), (BLOCK, blocks), (WHOLE, whole), (TAG, tags))]
    n_words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    rows = write_through(files.filter(F.col("text").rlike(CUE) | F.col("named"))
                         .select("k_id", "k_hash", "path", "named", n_words.alias("total"), F.explode(F.concat(*pieces)).alias("p"))
                         .select("k_id", "k_hash", "path", "named", "total", "p.kind", "p.seg"), "licence-sentences")
    scored = sentence_licences(rows.filter(F.col("kind") != TAG), templates)
    full = sentence_licences(rows.filter(F.col("kind").isin(BLOCK_SENTENCE, BLOCK, WHOLE)), headers())
    scored = scored.select("*", F.lit(False).alias("by_header")).unionByName(full.select("*", F.lit(True).alias("by_header")))
    for family, words in NEEDS:
        scored = scored.withColumn("score", F.when(F.col("license").startswith(family) & ~F.col("seg").rlike(words), 0.0).otherwise(F.col("score")))
    # The Affero licence is the GPL nearly word for word; the title tells them apart.
    scored = scored.withColumn("license", F.when((F.col("license") == "GPL-3.0") & F.lower("seg").rlike(r"^\W*gnu affero"), "AGPL-3.0").otherwise(F.col("license")))
    scored = write_through(scored, "licence-scores")
    known = F.create_map(*[F.lit(x) for lic in sorted({t[0] for t in (*templates, *headers())}) for x in (lic.lower(), lic)])
    plain = F.regexp_replace("seg", r"(?i)(-only|-or-later|\+)$", "")
    said = rows.filter(F.col("kind") == TAG).select("*", F.lit(2).cast("long").alias("n_words"),
                                                    F.coalesce(known[F.lower(plain)], plain).alias("license"), F.lit(1.0).alias("score"))
    hits = rows.join(scored, "seg").filter((F.col("kind") != TAG) & (~F.col("by_header") | (F.col("kind") != LINE))).drop("by_header")
    hits = hits.unionByName(said.select(*hits.columns))
    good = F.col("score") >= threshold
    best = F.struct(good.alias("good"), F.when(good, F.greatest(F.col("kind"), F.lit(BLOCK))).alias("rank"), "score", "license")
    covered = [F.coalesce(F.sum(F.when(good & F.col("kind").isin(*k), F.col("n_words"))), F.lit(0)) for k in ((LINE,), (BLOCK_SENTENCE,), (BLOCK,), (WHOLE,), (TAG,))]
    own = hits.groupBy("k_id", "k_hash", "path", "kind", "seg", "named", "total").agg(
        F.max(best).alias("best"), F.max("n_words").alias("n_words")) \
        .select("k_id", "k_hash", "path", "kind", "named", "total", "n_words", "best.*") \
        .groupBy("k_id", "k_hash", "path").agg(
        F.max_by(F.when(F.col("good"), F.col("license")), F.struct("good", "rank", "score", "license")).alias("own_license"), F.max("score").alias("score"),
        F.count_distinct(F.when(F.col("good"), F.col("license"))).alias("n_licenses"),
        F.max("named").alias("named"), F.max("total").alias("total"), F.greatest(*covered).alias("licence_words"))
    own = write_through(own, "licence-own")
    everyone = files.select("k_id", "k_hash", "path").withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", ""))
    all_ = write_through(everyone, "licence-paths")
    speaks = own.filter(F.col("own_license").isNotNull() & (F.col("named") | (F.col("licence_words") >= SHARE * F.col("total")))) \
        .select(F.regexp_replace("path", r"/?[^/]*$", "").alias("dir"), "own_license")
    votes = speaks.groupBy("dir", "own_license").agg(F.count(F.lit(1)).alias("n"))
    declared = votes.withColumn("r", F.row_number().over(Window.partitionBy("dir").orderBy(F.desc("n"), "own_license"))) \
        .filter("r = 1").select(F.col("dir").alias("from_dir"), F.col("own_license").alias("dir_license"))
    # Each directory with all its ancestors: a/b/c, a/b, a and the root.
    dirs = all_.groupBy("dir").agg(F.count(F.lit(1)).alias("n_files"))
    parts = F.split("dir", "/")
    up = dirs.withColumn("depth", F.explode(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts))))) \
        .withColumn("from_dir", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    near = up.join(declared, "from_dir").groupBy("dir").agg(F.max_by(F.struct("from_dir", "dir_license"), "depth").alias("near"))
    dirs = write_through(dirs.join(near, "dir", "left").select("dir", "n_files", "near.from_dir", "near.dir_license"), "licence-dirs")
    j = join_groups(all_, dirs, "dir", "n_files", all_.count())
    j = j.join(own.select("k_id", "k_hash", "path", "own_license", "score", "n_licenses"), ["k_id", "k_hash", "path"], "left")
    return j.select("k_id", "k_hash", "path", "own_license", "score", F.coalesce("n_licenses", F.lit(0)).alias("n_licenses"),
                    F.when(F.col("own_license").isNull(), F.col("from_dir")).alias("from_dir"),
                    F.coalesce("own_license", "dir_license").alias("license"))


def scan_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``scan`` over documents laid out as source/lang/doc_id; one row per document, doc_id first.

    A null source, language or id has ``none`` in its place in the path and
    comes back null in doc_id.  Other columns are ignored.
    """
    kid, kh = row_key(docs)
    part = lambda c: F.coalesce(docs[c].cast("string"), F.lit("none"))
    files = docs.select(kid.alias("k_id"), kh.alias("k_hash"), docs["text"].alias("text"),
                        F.concat_ws("/", part("source"), part("lang"), part("doc_id")).alias("path"))
    return scan(files, threshold).select(F.when(F.col("k_id") != F.lit(NULL_ID), F.col("k_id")).alias("doc_id"),
                                         "path", "own_license", "score", "n_licenses", "from_dir", "license")
