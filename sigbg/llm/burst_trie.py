"""Prefix trie of conversations by bursting containers (operator 12).

Equal conversations are counted once and stand for their copies.  All distinct
ones start in one container under the root.  A container with more than LIMIT
suffixes bursts: its head becomes a node, and its members move to containers
under the heads one turn further, by their next turn's id.  The containers
that remain are small: they are sorted and swept, which meets every node of
their subtrees once.  What a burst node's subtree adds up to comes from the
containers and burst nodes below it.

A prefix that more than LIMIT different conversations share costs a round a
turn.  A conversation's turns (16 bytes each) are one row; texts don't move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_through
from .common import text_of

#: Distinct suffixes that a container holds at most.
LIMIT = 512
#: Ids of a chunk of the list that is hashed: at most 2 ** CHUNK_BITS.
CHUNK_BITS = 10
WORDS = r"[^\x20\x09-\x0D]+"
NOBODY = hashlib.sha256(b"").hexdigest()


def turn_lists(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as (turn, id, words); rows without conv_id are left out.

    A turn's id is a digest of its role and text (null: empty).  Null turns come
    first, rows of one turn number in the order of their ids.
    """
    role, text = text_of(conversations["role"]), text_of(conversations["text"])
    rows = conversations.filter(conversations["conv_id"].isNotNull()).select(
        conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].alias("turn"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("id"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "words"))).alias("turns"))


def rebuilt(lists: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """(conv_id, ids, words) of every conversation c: the first h turns of c - c % family, then its own after its first h.

    h is the crc32 of c's decimal digits modulo ``most``.
    """
    own = lists.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % family).alias("base"),
                       (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int").alias("h"))
    heads = lists.filter(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("first"))
    j = own.join(heads, "base", "left")
    head = F.when(F.col("first").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("first", F.lit(1), F.col("h")))
    tail = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    all_turns = F.concat(head, tail)
    return j.select("conv_id", F.transform(all_turns, lambda t: t["id"]).alias("ids"),
                    F.transform(all_turns, lambda t: t["words"]).alias("words"))


def ends_digests(members: DataFrame) -> DataFrame:
    """(seq, ends): SHA-256 of the ascending, comma-joined ids of ``members(seq, conv_id)``.

    Ids are sorted and joined in chunks of at most 2 ** CHUNK_BITS in the JVM;
    a task then feeds the chunks of a list to its hash one after the other,
    however long the list is.
    """
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string"))
    chunks = members.groupBy("seq", F.shiftright("conv_id", CHUNK_BITS).alias("part")).agg(F.concat_ws(",", ids).alias("ids"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, state = None, None
        for b in batches:
            names, ends = [], []
            for s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if s == seq:
                    state.update(b",")
                else:
                    if seq is not None:
                        names.append(seq)
                        ends.append(state.hexdigest())
                    seq, state = s, hashlib.sha256()
                state.update(x.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ends, pa.string())], ["seq", "ends"])
        if seq is not None:
            yield pa.RecordBatch.from_arrays([pa.array([seq], pa.string()), pa.array([state.hexdigest()], pa.string())], ["seq", "ends"])

    return chunks.repartition("seq").sortWithinPartitions("seq", "part").select("seq", "ids").mapInArrow(task, "seq string, ends string")


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """(conv_id, n, ends, ids, words): one row per distinct sequence of turns, its smallest id, copies and list digest."""
    keyed = write_through(convs.withColumn("seq", F.md5(F.concat_ws("", F.transform("ids", F.hex)).cast("binary"))), "trie-sequences")
    seqs = keyed.groupBy("seq").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"),
                                    F.first("ids").alias("ids"), F.first("words").alias("words"))
    return seqs.join(ends_digests(keyed.select("seq", "conv_id")), "seq").select("conv_id", "n", "ends", "ids", "words")


def _under(head: Column, turn: Column) -> Column:
    return F.unhex(F.md5(F.concat(head, turn)))


def burst(seqs: DataFrame, limit: int) -> tuple[DataFrame, list[DataFrame]]:
    """(rows of the containers that remain, burst nodes of each depth).

    Rows keep their whole sequence and get head, depth and last_words of the
    container's head and path, the heads of the burst nodes above it.
    """
    top = F.lit(b"").cast("binary")
    active = seqs.select("*", top.alias("head"), F.array().cast("array<binary>").alias("path"), F.lit(0).cast("long").alias("last_words"))
    left, nodes, depth = [], [], 0
    while True:
        active = write_through(active, f"trie-active-{depth}").withColumn("depth", F.lit(depth).cast("long"))
        groups = active.groupBy("head").agg(
            F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"),
            F.max(F.when(F.size("ids") == depth, F.col("ends"))).alias("ends"), F.first("path").alias("path"),
            F.first("last_words").alias("last_words"))
        over = write_through(groups.filter(F.col("rows") > limit), f"trie-burst-{depth}")
        if over.isEmpty():
            return reduce(DataFrame.unionByName, [*left, active]), nodes
        nodes.append(over.withColumn("depth", F.lit(depth).cast("long")).drop("rows"))
        # A stored table of heads: small ones are broadcast by their size, others joined by shuffle.
        marked = active.join(over.select("head", F.lit(True).alias("bursts")), "head", "left")
        left.append(marked.filter("bursts IS NULL").drop("bursts"))
        at = F.lit(depth + 1)
        active = marked.filter(F.col("bursts") & (F.size("ids") > depth)).select(
            "conv_id", "n", "ends", "ids", "words", _under(F.col("head"), F.element_at("ids", at)).alias("head"),
            F.concat("path", F.array("head")).alias("path"), F.element_at("words", at).alias("last_words"))
        depth += 1


class _Node:
    __slots__ = ("depth", "words", "conv", "n", "children", "leaves", "saved", "ends", "kids")

    def __init__(self, depth: int, words: int):
        self.depth, self.words, self.conv, self.n = depth, words, None, 0
        self.children = self.leaves = self.saved = 0
        self.ends, self.kids = NOBODY, []


FIELDS = [("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
          ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("head", pa.binary()), ("path", pa.list_(pa.binary()))]
SWEPT = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
         "ends_sha256 string, head binary, path array<binary>")


class Sweep:
    """Nodes of sorted containers: a stack of open nodes; a node is given out when its parent closes."""

    def __init__(self):
        self.out: list[tuple] = []
        self.head = self.path = self.last = None
        self.stack: list[_Node] = []

    def _close(self) -> None:
        node = self.stack.pop()
        node.saved += (node.n - 1) * node.words
        node.leaves = node.leaves or 1
        self.out.extend((k[0], k[1], node.conv, *k[2:]) for k in node.kids)
        row = (node.conv, node.depth, node.n, node.children, node.leaves, node.saved, node.ends)
        if not self.stack:
            self.out.append((row[0], row[1], None, *row[2:], self.head, self.path))
            return
        up = self.stack[-1]
        up.conv = node.conv if up.conv is None else min(up.conv, node.conv)
        up.n += node.n
        up.children += 1
        up.leaves += node.leaves
        up.saved += node.saved
        up.kids.append((*row, None, None))

    def finish(self) -> None:
        while self.stack:
            self._close()
        self.last = None

    def add(self, head: bytes, path: list, depth: int, last_words: int, conv: int, n: int, ends: str, ids: list, words: list) -> None:
        """The next row in the order of (head, ids); rows of a container differ in ids."""
        if not self.stack or head != self.head:
            self.finish()
            self.head, self.path = head, path
            self.stack.append(_Node(depth, last_words))
            common = depth
        else:
            common, most = depth, min(len(ids), len(self.last))
            while common < most and ids[common] == self.last[common]:
                common += 1
            while self.stack[-1].depth > common:
                self._close()
        for d in range(common, len(ids)):
            self.stack.append(_Node(d + 1, words[d]))
        end = self.stack[-1]
        end.conv = conv if end.conv is None else min(end.conv, conv)
        end.n += n
        end.ends = ends
        self.last = ids

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.out)) or [()] * len(FIELDS)
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, FIELDS)], [f for f, _ in FIELDS])


def sweep(containers: DataFrame) -> DataFrame:
    """All nodes of the containers; those of their heads carry head and path, all others their parent's conv_id."""
    cols = ["head", "path", "depth", "last_words", "conv_id", "n", "ends", "ids", "words"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Sweep()
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in cols)):
                s.add(*row)
            yield s.batch()
        s.finish()
        yield s.batch()

    return containers.select(*cols).repartition("head").sortWithinPartitions("head", "ids").mapInArrow(task, SWEPT)


def trie(convs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The nodes of the prefix trie of ``convs(conv_id, ids, words)``, one row per conversation.

    conv_id (smallest member), depth, parent_conv_id (root: null), n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.  A conversation without
    turns is a member of the root only; without conversations there is no row.
    """
    containers, bursts = burst(distinct_sequences(convs), limit)
    nodes = write_through(sweep(containers), "trie-nodes")
    cols = [f for f, _ in FIELDS[:8]]
    if not bursts:
        return nodes.select(*cols)
    up = reduce(DataFrame.unionByName, bursts).withColumn("own", (F.col("n_convs") - 1) * F.col("last_words"))
    tops = nodes.filter("head IS NOT NULL")
    parent = F.element_at("path", -1)
    below = tops.select(F.explode("path").alias("head"), "n_leaves", "saved_tokens") \
        .unionByName(up.select(F.explode(F.concat("path", F.array("head"))).alias("head"), F.lit(0).cast("long").alias("n_leaves"),
                               F.col("own").alias("saved_tokens"))) \
        .groupBy("head").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    children = tops.select(parent.alias("head")).unionByName(up.filter("size(path) > 0").select(parent.alias("head"))) \
        .groupBy("head").agg(F.count(F.lit(1)).alias("n_children"))
    link = up.select(F.col("head").alias("parent"), F.col("conv_id").alias("parent_conv"))
    heads = up.join(below, "head").join(children, "head").withColumn("ends_sha256", F.coalesce("ends", F.lit(NOBODY)))
    above = lambda df: df.withColumn("parent", F.when(F.size("path") > 0, F.try_element_at("path", F.lit(-1)))) \
        .join(link, "parent", "left").withColumn("parent_conv_id", F.col("parent_conv")).select(*cols)
    return nodes.filter("head IS NULL").select(*cols).unionByName(above(tops)).unionByName(above(heads))


def conversation_trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The trie of the rebuilt conversations of ``conversations(conv_id, turn, role, text)``.

    Null role or text counts as empty, null turns come first; rows without a
    conv_id are in no conversation; repeated rows are turns of their own.  An
    empty table gives no rows.  Other columns are ignored.
    """
    return trie(rebuilt(write_through(turn_lists(conversations), "trie-turns")), limit)


SQL = r"""
WITH t AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')}
                                ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS own
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
z AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
        lambda c, u: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
c AS (SELECT t.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
        lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 4 AS h FROM t, z),
r AS (SELECT c.conv_id, list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:]) AS seq
      FROM c LEFT JOIN t b ON b.conv_id = c.conv_id - c.conv_id % 20),
m AS (SELECT conv_id, unnest(range(0, len(seq) + 1)) AS depth, seq FROM r),
n AS (SELECT depth, seq[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(seq) = depth), '')) AS ends_sha256
      FROM m GROUP BY ALL),
w AS (SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(path[-1].t, '[^\x20\x09-\x0D]+')) END AS own,
             row_number() OVER () AS id FROM n),
k AS (SELECT a.id, count(*) FILTER (WHERE d.depth = a.depth + 1) AS n_children, sum(d.own) AS saved_tokens,
             count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM w e WHERE e.depth = d.depth + 1 AND e.path[1:d.depth] = d.path)) AS n_leaves
      FROM w a JOIN w d ON d.depth >= a.depth AND d.path[1:a.depth] = a.path GROUP BY a.id)
SELECT w.conv_id, w.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, w.n_convs, k.n_children, k.n_leaves,
       k.saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
FROM w JOIN k USING (id) LEFT JOIN w p ON p.depth = w.depth - 1 AND p.path = w.path[1:w.depth - 1]"""
