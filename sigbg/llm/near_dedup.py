"""Near-duplicate groups by a multi-index Hamming join of minwise signatures (operator 9).

A document's set is its distinct word shingles; equal sets are one class.  A
class has a signature of ``symbols`` 16-bit minwise symbols; the share of
unequal symbols estimates 1 - similarity.  The signature is split into chunks
of ``chunk`` symbols, and each chunk is entered once for every way to leave out
``errors`` of its symbols.  By the pigeonhole principle two signatures that
differ in at most ``radius = chunks * (errors + 1) - 1`` symbols agree in one
of these entries, so no pair within the radius is missed.  The radius lies so
far above the expected distance at the threshold that a link is lost with a
probability below 1e-4 even at the threshold itself.

Pairs are never listed for a whole bucket.  The pivot of a bucket is its most
central member (the one whose buckets hold most members: in a family of edited
copies that is the original), and a pivot's family is everything that shares a
bucket with it.  Members are first compared with their pivot.  Those that link
to it are one component with it; a member that doesn't - a single - may still
link with others of its family, so singles are compared with the whole family,
in blocks of bounded size that are dealt to tasks of their own and return links
only.  Two documents of one bucket are thus either linked to its pivot both or
compared directly, by signature and then on the full sets of the whole texts.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_through
from .common import NULL_ID, join_groups, row_key, text_of
from .components import components
from .shingles import Shingler, Signer, set_digest

BLOCK = 512
SETS_KEPT = 64


def signatures(docs: DataFrame, k: int, symbols: int) -> DataFrame:
    """(k_id, k_hash, cid, n, sig) per row; cid identifies the set, null for an empty one."""
    kid, kh = row_key(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(k), Signer(symbols)
        for b in batches:
            cid, n, sig = [], [], []
            for t in b.column(2):
                s = shingler.shingles(t.as_py())
                n.append(len(s))
                cid.append(int.from_bytes(set_digest(s)[:8], "little", signed=True) if len(s) else None)
                sig.append(signer.sign(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(cid, pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.binary())],
                ["k_id", "k_hash", "cid", "n", "sig"])

    return docs.select(kid.alias("k_id"), kh.alias("k_hash"), text_of(docs["text"]).cast("binary").alias("t")) \
        .mapInArrow(run, "k_id long, k_hash long, cid long, n long, sig binary")


def bucket_entries(classes: DataFrame, symbols: int, chunk: int, errors: int) -> DataFrame:
    """(key, cid): one row per chunk and way to leave out ``errors`` of its symbols."""
    keep = [c for c in combinations(range(chunk), chunk - errors)]
    if 16 * (chunk - errors) > 48 or (symbols // chunk) * len(keep) >= 1 << 15:
        raise ValueError("an entry must fit in 64 bits: at most 3 symbols and 32767 entries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            cid = b.column(0).to_numpy(zero_copy_only=False)
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint16).reshape(len(b), symbols).astype(np.int64)
            for c in range(symbols // chunk):
                keys = []
                for j, kept in enumerate(keep):
                    key = np.full(len(b), c * len(keep) + j, dtype=np.int64)
                    for i in kept:
                        key = (key << 16) | sig[:, c * chunk + i]
                    keys.append(key)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(cid, len(keep)))],
                                                 ["key", "cid"])

    return classes.select("cid", "sig").mapInArrow(run, "key long, cid long")


def within_radius(pairs: DataFrame, classes: DataFrame, radius: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose signatures differ in at most ``radius`` symbols and whose set sizes allow the similarity."""
    side = lambda c: classes.select(F.col("cid").alias(c), F.col("n").alias("n" + c), F.col("sig").alias("s" + c))
    both = pairs.join(side("a"), "a").join(side("b"), "b") \
        .filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), dtype=np.uint16).reshape(len(b), -1) for i in (2, 3))
            near = (x != y).sum(axis=1) <= radius
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(near))

    return both.mapInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity: 100 * common >= percent * all."""
    side = lambda c: texts.select(F.col("cid").alias(c), F.col("text").alias("t" + c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sets = Shingler(k), OrderedDict()

        def shingles(cid: int, text: pa.Scalar) -> np.ndarray:
            s = sets.get(cid)
            if s is None:
                s = sets[cid] = shingler.shingles(text.as_py())
                if len(sets) > SETS_KEPT:
                    sets.popitem(last=False)
            return s

        for b in batches:
            yes = []
            for i, (x, y) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                s, t = shingles(x, b.column(2)[i]), shingles(y, b.column(3)[i])
                common = len(np.intersect1d(s, t, assume_unique=True))
                yes.append(100 * common >= percent * (len(s) + len(t) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(yes, pa.bool_()))

    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _block_links(rows: list[tuple], percent: int, radius: int, shingler: Shingler) -> list[tuple[int, int]]:
    """Links of the singles of one block with its members; rows are (cid, single, own, sig, n, text).

    ``single`` marks the rows to compare with all others, ``own`` those that
    don't link to the pivot (in a family of several blocks they come as members
    too).  Pairs that are connected already are skipped.
    """
    rows = list({r[0]: r for r in sorted(rows, key=lambda r: r[1])}.values())      # a single may come as a member too
    sig = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint16).reshape(len(rows), -1)
    n = np.array([r[4] for r in rows], dtype=np.int64)
    single = np.array([r[1] for r in rows], dtype=bool)
    sets: dict[int, np.ndarray] = {}
    top = list(range(len(rows)))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    def of(x: int) -> np.ndarray:
        if x not in sets:
            sets[x] = shingler.shingles(rows[x][5])
        return sets[x]

    linked = [i for i in range(len(rows)) if not rows[i][2]]
    for i in linked[1:]:
        top[find(i)] = find(linked[0])                                             # through the pivot
    links = []
    for i in np.flatnonzero(single).tolist():
        near = (sig != sig[i]).sum(axis=1) <= radius
        near &= 100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])
        near[i] = False
        near[:i] &= ~single[:i]                                                    # two singles once
        for j in np.flatnonzero(near).tolist():
            if find(i) != find(j):
                s, t = of(i), of(j)
                common = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * common >= percent * (len(s) + len(t) - common):
                    top[find(i)] = find(j)
                    links.append((rows[i][0], rows[j][0]))
    return links


def family_links(family: DataFrame, linked: DataFrame, classes: DataFrame, texts: DataFrame, k: int, percent: int,
                 radius: int) -> DataFrame:
    """Links of the singles of each family(pivot, cid) with its other members.

    Families are cut into blocks of about BLOCK members; block b of the singles
    meets block t of all members in the task of (pivot, t, b).
    """
    f = family.join(linked, ["pivot", "cid"], "left").withColumn("single", F.col("hit").isNull()).drop("hit")
    size = f.groupBy("pivot").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("single").cast("int")).alias("s")).filter("m > 1 AND s > 0")
    f = f.join(size, "pivot").withColumn("nt", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("ns", F.ceil(F.col("s") / BLOCK).cast("int"))
    at = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    member = f.filter(~F.col("single") | (F.col("ns") * F.col("nt") > 1)).withColumn("t", at("nt")).withColumn("b", each("ns")) \
        .select("pivot", "t", "b", "cid", F.lit(False).alias("single"), F.col("single").alias("own"))
    single = f.filter("single").withColumn("b", at("ns")).withColumn("t", each("nt")) \
        .select("pivot", "t", "b", "cid", "single", F.lit(True).alias("own"))
    rows = member.union(single).join(classes.select("cid", "sig", "n"), "cid").join(texts, "cid") \
        .select("pivot", "t", "b", "cid", "single", "own", "sig", "n", F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, now, group = Shingler(k), None, []

        def links() -> pa.RecordBatch:
            found = _block_links(group, percent, radius, shingler)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        for b in batches:
            cols = [c.to_pylist() for c in b.columns[:8]]
            for i, (p, t, s, cid, one, own, sig, n) in enumerate(zip(*cols)):
                if (p, t, s) != now:
                    if group:
                        yield links()
                    now, group = (p, t, s), []
                group.append((cid, one, own, sig, n, b.column(8)[i].as_py()))
        if group:
            yield links()

    return rows.repartition("pivot", "t", "b").sortWithinPartitions("pivot", "t", "b", "cid").mapInArrow(run, "a long, b long")


def class_links(classes: DataFrame, texts_of, k: int, percent: int, symbols: int, chunk: int, errors: int) -> DataFrame:
    """(node, comp): components of the classes that link with any other class."""
    radius = (symbols // chunk) * (errors + 1) - 1
    entries = bucket_entries(classes, symbols, chunk, errors)
    buckets = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = write_through(entries.join(buckets, "key"), "near-members")
    central = members.groupBy("cid").agg(F.sum("size").alias("weight"))
    pivots = members.join(central, "cid").groupBy("key").agg(F.max(F.struct("weight", "cid")).alias("p")).select("key", F.col("p.cid").alias("pivot"))
    family = write_through(members.join(pivots, "key").filter("cid <> pivot").select("pivot", "cid").distinct(), "near-family")
    texts = write_through(texts_of(members.select("cid").distinct()).withColumnRenamed("t", "text"), "near-texts")
    pairs = family.select(F.col("pivot").alias("a"), F.col("cid").alias("b"))
    to_pivot = write_through(confirm(within_radius(pairs, classes, radius, percent), texts, k, percent), "near-pivot-links")
    linked = to_pivot.select(F.col("a").alias("pivot"), F.col("b").alias("cid"), F.lit(True).alias("hit"))
    rest = write_through(family_links(family, linked, classes, texts, k, percent, radius), "near-family-links")
    return components(to_pivot.union(rest))


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80, symbols: int = 40, chunk: int = 4,
                errors: int = 1) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, k_id, k_hash, group.

    Documents link when 100 * common >= percent * all of their shingle sets;
    component_id is the smallest doc_id reachable over links, kept marks it;
    group tells components of one id apart (null for an empty set).  A text without words (null counts as one) has an empty set and links with
    nothing.  Repeated rows have equal sets and so are one group.  A null id
    sorts below all others.  Empty table: empty result; other columns are
    ignored.
    """
    rows = write_through(signatures(docs, k, symbols), "near-signatures")
    n_rows = rows.count()
    classes = write_through(rows.filter("cid IS NOT NULL").groupBy("cid").agg(
        F.min("k_id").alias("rep"), F.min_by("k_hash", "k_id").alias("rep_hash"), F.first("n").alias("n"),
        F.first("sig").alias("sig"), F.count(F.lit(1)).alias("size")), "near-classes")

    def texts_of(cids: DataFrame) -> DataFrame:
        kid, kh = row_key(docs)
        named = classes.join(cids, "cid", "left_semi").select("cid", F.col("rep").alias("k_id"), F.col("rep_hash").alias("k_hash"))
        w = Window.partitionBy("k_id", "k_hash").orderBy("cid")      # repeated rows: one text of each class
        return docs.select(kid.alias("k_id"), kh.alias("k_hash"), text_of(docs["text"]).cast("binary").alias("t")) \
            .join(named, ["k_id", "k_hash"]).withColumn("i", F.row_number().over(w)).filter("i = 1").select("cid", "t")

    comp = class_links(classes, texts_of, k, percent, symbols, chunk, errors)
    c = classes.select("cid", "rep", "size").join(comp.select(F.col("node").alias("cid"), "comp"), "cid", "left") \
        .withColumn("comp", F.coalesce("comp", "cid"))
    low = c.groupBy("comp").agg(F.min("rep").alias("component"))
    groups = write_through(c.join(low, "comp").select("cid", "component", "size", F.col("comp").alias("group")), "near-groups")
    full = join_groups(rows.filter("cid IS NOT NULL").select("k_id", "k_hash", "n", "cid"), groups, "cid", "size", n_rows)
    out = full.select("k_id", "k_hash", "n", "component", "group") \
        .unionByName(rows.filter("cid IS NULL").select("k_id", "k_hash", "n", F.col("k_id").alias("component"),
                                                       F.lit(None).cast("long").alias("group")))
    real = lambda x: F.when(F.col(x) != F.lit(NULL_ID), F.col(x))
    return out.select(real("k_id").alias("doc_id"), F.col("n").alias("n_shingles"), real("component").alias("component_id"),
                      (F.col("k_id") == F.col("component")).alias("kept"), "k_id", "k_hash", "group")


def representatives(groups: DataFrame) -> DataFrame:
    """(k_id, k_hash, k_n) of the rows that stay: one of each component, and every row with an empty set."""
    one = groups.filter("group IS NOT NULL").groupBy("group").agg(F.min(F.struct("k_id", "k_hash")).alias("m")) \
        .select("m.k_id", "m.k_hash", F.lit(1).cast("long").alias("k_n"))
    return one.union(groups.filter("group IS NULL").groupBy("k_id", "k_hash").agg(F.count(F.lit(1)).alias("k_n")))
