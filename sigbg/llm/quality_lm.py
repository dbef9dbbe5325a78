"""Quality classifier: interpolated modified Kneser-Ney n-gram model (operator 10).

The model's words are code points: letters of every script stand for
themselves (from U+4000 on, hashed to 2**14 symbols), digits are one symbol,
white space another.  The n-grams of order 4 are exact 60-bit numbers, so every
table here grows with the texts and is dealt by n-gram, context or block; none
goes to the driver or to all tasks.

1. blocks: the documents are stored once, in blocks of ``BLOCK`` bytes of text,
   bucketed by block, so that later passes meet other tables block by block
   without moving the texts;
2. counts: trusted ids are dealt to the blocks; a block gives each of its
   distinct n-grams once, with its number in training texts;
3. model: counts, continuation counts, context totals and discounts are tables
   dealt by n-gram or context and joined there; every n-gram type that occurs
   anywhere gets its interpolated log-probability;
4. scores: the distinct n-grams of each block are joined with the model, and
   the block's texts with those; a score is the mean negative log-probability,
   shrunk towards the language's trusted mean by ``PRIOR`` symbols;
5. thresholds: per language, quantiles of the trusted documents' scores on both
   sides (gibberish is improbable, endless repetition too probable); see Judge.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path, write_through
from .common import NULL_ID

BITS = 15
ORDER = 4
SYMBOLS = 1 << BITS
PRIOR = 64
CHUNK = 1 << 20
BLOCK = 1 << 24
MAX_BUCKETS = 100_000


def _symbol_table() -> np.ndarray:
    """Code point -> symbol: 0 white space and controls, one for all digits, itself below 2**14, hashed above."""
    cp = np.arange(0x110000, dtype=np.uint64)
    t = np.where(cp < SYMBOLS // 2, cp, SYMBOLS // 2 + (cp * np.uint64(0x9E3779B1) >> np.uint64(7)) % (SYMBOLS // 2)).astype(np.int64)
    t[:33] = 0
    t[48:58] = 48
    t[[0xA0, 0x2028, 0x2029, 0x3000]] = 0
    return t


SYMBOL = _symbol_table()


def ngram_codes(text: bytes | None) -> Iterator[np.ndarray]:
    """Codes of the n-grams that end at each code point of a text, at most ``CHUNK`` at a time.

    White space stands before the text; bytes that aren't UTF-8 are U+FFFD.
    """
    s = (text or b"").decode("utf-8", "replace")
    lead = np.zeros(ORDER - 1, dtype=np.int64)
    for a in range(0, len(s), CHUNK):
        x = np.concatenate([lead, SYMBOL[np.frombuffer(s[a:a + CHUNK].encode("utf-32-le"), dtype="<u4")]])
        n = len(x) - ORDER + 1
        code = np.zeros(n, dtype=np.int64)
        for k in range(ORDER):
            code = code << BITS | x[k:k + n]
        yield code
        lead = x[n:]


def _texts(column: pa.ChunkedArray) -> Iterator[bytes | None]:
    """Texts of a column as raw bytes, one at a time."""
    for chunk in column.chunks:
        for x in chunk.cast(pa.large_binary() if pa.types.is_large_string(chunk.type) else pa.binary()):
            yield x.as_py()


class Blocks:
    """Documents stored in blocks: ``k_id`` (a null id is NULL_ID),
    c0, c1, ... for the columns of ``docs``, and the block ``b``.

    The table is bucketed by ``b`` and lies in the shared folder.  A task cuts
    its rows into blocks as it reads them, so blocks hold like amounts of text
    whatever the ids, and no text is shuffled, now or when a block meets what
    is dealt to it.
    """

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        spark, at = docs.sparkSession, {c: f"c{i}" for i, c in enumerate(docs.columns)}
        self.columns, self.lang, self.text = list(at.values()), at["lang"], at["text"]
        flat = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("k_id"),
                           *[docs[c].alias(at[c]) for c in docs.columns])
        text = self.text

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task, before = TaskContext.get().partitionId() << 32, 0
            for b in batches:
                size = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                end = before + np.cumsum(size)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(task + (end - size) // BLOCK)], [*b.schema.names, "b"])
                before = int(end[-1]) if len(end) else before

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in flat.schema)
        size = flat.agg(F.sum(F.octet_length(text))).first()[0] or 0
        buckets = min(MAX_BUCKETS, 1 + 2 * size // BLOCK)
        name = "lm_blocks_" + os.urandom(6).hex()
        flat.mapInArrow(run, f"{schema}, b long").write.format("parquet").option("compression", "zstd").bucketBy(buckets, "b") \
            .option("path", scratch_path(spark, "lm-blocks")).saveAsTable(name)
        self.table = spark.table(name)

    def meet(self, columns: list[str], side: DataFrame, run, schema: str) -> DataFrame:
        """``run(columns of a block, its rows of side)`` for every block that has documents."""
        return self.table.select("b", *columns).groupBy("b").cogroup(side.groupBy("b")).applyInArrow(run, schema)


def ngram_counts(blocks: Blocks, train: DataFrame) -> DataFrame:
    """(b, code, n): each block's distinct n-grams with their number in the texts named by train(doc_id)."""
    ids = write_through(blocks.table.select("k_id", "b").join(train.select(F.col("doc_id").alias("k_id")), "k_id")
                        .select("b", "k_id").distinct(), "lm-ids")
    text = blocks.text

    def merged(parts: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        seen, at = np.unique(np.concatenate(parts), return_inverse=True)
        return seen, np.bincount(at, weights=np.concatenate(counts), minlength=len(seen)).astype(np.int64)

    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        good = set(side.column("k_id").to_pylist())
        seen, n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        parts: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0
        for k, t in zip(docs.column("k_id").to_pylist(), _texts(docs.column(text))):
            for code in ngram_codes(t):
                parts.append(code)
                counts.append(np.full(len(code), int(k in good), dtype=np.int64))
                held += len(code)
                if held > 2 * CHUNK:
                    seen, n = merged([seen, *parts], [n, *counts])
                    parts, counts, held = [], [], 0
        seen, n = merged([seen, *parts], [n, *counts])
        b = docs.column("b")[0].as_py() if len(docs) else 0
        return pa.table({"b": pa.array(np.full(len(seen), b, dtype=np.int64)), "code": seen, "n": n})

    return blocks.meet(["k_id", text], ids, run, "b long, code long, n long")


def _discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts D1, D2, D3+ from the counts of counts."""
    n = [0, 0, 0, 0, 0]
    for r in counts.filter("n <= 4").groupBy("n").count().collect():      # four rows at most
        n[int(r["n"])] = r["count"]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    d = []
    for k in (1, 2, 3):
        v = k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5 * k
        d.append(min(max(v, 0.1), k - 0.05))
    return d


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(code, logp) for every n-gram type of ``counts(code, n)``; n is 0 for types outside the training texts.

    The highest order uses the training counts, each lower order the number of
    distinct left neighbours; unseen contexts fall through to the next order,
    the lowest to the uniform distribution.
    """
    level = counts.filter("n > 0").select("code", "n")
    tables = []
    for order in range(ORDER, 0, -1):
        tables.append((order, level))
        level = level.groupBy(F.col("code").bitwiseAND(F.lit((1 << (BITS * (order - 1))) - 1)).alias("code")) \
            .agg(F.count(F.lit(1)).alias("n"))
        if order > 1:
            level = write_through(level, "lm-level")
    probs = None
    for order, c in reversed(tables):
        d1, d2, d3 = _discounts(c)
        off = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        ctx = c.withColumn("ctx", F.shiftright("code", BITS)).groupBy("ctx").agg(
            F.sum("n").alias("total"), (F.sum(off) / F.sum("n")).alias("gamma"))
        seen = c.select("code", F.greatest(F.col("n") - off, F.lit(0.0)).alias("above"))
        # Distinct n-grams of this order: a context or suffix is then shared by at most SYMBOLS rows.
        mask = (1 << (BITS * order)) - 1
        grams = counts.select(F.col("code").bitwiseAND(F.lit(mask)).alias("code")).distinct() \
            .withColumn("ctx", F.shiftright("code", BITS))
        if probs is None:
            grams = grams.withColumn("low", F.lit(1.0 / SYMBOLS))
        else:
            grams = grams.withColumn("suffix", F.col("code").bitwiseAND(F.lit(mask >> BITS))) \
                .join(probs.select(F.col("code").alias("suffix"), F.col("p").alias("low")), "suffix")
        probs = grams.join(seen, "code", "left").join(ctx, "ctx", "left") \
            .select("code", F.when(F.col("total").isNull(), F.col("low"))
                    .otherwise(F.coalesce("above", F.lit(0.0)) / F.col("total") + F.col("gamma") * F.col("low")).alias("p"))
    return probs.select("code", F.log("p").alias("logp"))


def score(blocks: Blocks, grams: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of every row of the blocks with its nll and n_symbols; grams(b, code, logp) holds each block's n-grams."""
    text, types = blocks.text, dict(blocks.table.dtypes)
    need = list(dict.fromkeys([*columns, text]))

    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        code = side.column("code").to_numpy()
        order = np.argsort(code)
        code, logp = code[order], side.column("logp").to_numpy()[order]
        nll, n = np.zeros(len(docs)), np.zeros(len(docs), dtype=np.int64)
        for i, t in enumerate(_texts(docs.column(text))):
            for c in ngram_codes(t):
                nll[i] -= logp[np.searchsorted(code, c)].sum()
                n[i] += len(c)
        return docs.select(columns).append_column("nll", pa.array(nll)).append_column("n_symbols", pa.array(n))

    return blocks.meet(need, grams, run, ", ".join(f"{c} {types[c]}" for c in columns) + ", nll double, n_symbols long")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents labelled good and never bad or toxic; null labels don't count as good."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic") \
        .groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"),
                               F.count("quality").alias("nq"), F.count(F.lit(1)).alias("n")) \
        .filter("doc_id IS NOT NULL AND q = 1 AND nq = n AND coalesce(t, 0) = 0").select("doc_id")


class Judge:
    """A trained classifier: model, and per language the trusted mean and score limits.

    The model is trained on one half of the trusted documents (by a hash of
    the id); the upper limits come from the other half, since texts score
    better under a model that has seen them; the lower ones from both.  Limits
    of few documents move out by twice the quantile's distance from the median
    over the root of their number.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, low: float = 0.002, high: float = 0.998, slack: float = 0.05):
        half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
        good = write_through(trusted_ids(labels).withColumn("seen", half), "lm-trusted")
        self.blocks = Blocks(docs)
        types = write_through(ngram_counts(self.blocks, good.filter("seen")), "lm-types")
        model = kneser_ney(types.groupBy("code").agg(F.sum("n").alias("n")))
        self.grams = write_through(types.select("b", "code").join(model, "code"), "lm-grams")
        self.rows = write_through(
            score(self.blocks, self.grams, ["k_id", self.blocks.lang]).withColumnRenamed(self.blocks.lang, "lang")
            .withColumn("lang", F.col("lang").cast("string")), "lm-scores")
        of = self.rows.join(good.select(F.col("doc_id").alias("k_id"), "seen"), "k_id").filter("n_symbols > 0")
        total = of.agg(F.sum("nll").alias("a"), F.sum("n_symbols").alias("b")).first()
        self.mean = (total["a"] / total["b"]) if total["b"] else 0.0
        means = write_through(of.groupBy(F.col("lang").alias("m_lang"))
                              .agg((F.sum("nll") / F.sum("n_symbols")).alias("mean")), "lm-means")
        of = of.join(means, F.col("lang").eqNullSafe(F.col("m_lang"))).withColumn("score", self._score()) \
            .withColumn("fresh", F.when(~F.col("seen"), F.col("score")))
        agg = [F.first("mean").alias("mean"), F.percentile_approx("score", [low, 0.5], 100_000).alias("l"), F.count("score").alias("nl"),
               F.percentile_approx("fresh", [0.5, high], 100_000).alias("u"), F.count("fresh").alias("nu")]
        lower = F.col("l")[0] - slack - 2 * (F.col("l")[1] - F.col("l")[0]) / F.sqrt("nl")
        upper = F.col("u")[1] + slack + 2 * (F.col("u")[1] - F.col("u")[0]) / F.sqrt("nu")
        all_ = of.agg(*agg).select(lower.alias("lower"), upper.alias("upper")).first()
        self.lower, self.upper = (v if v is not None else d for v, d in zip(all_, (float("-inf"), float("inf"))))
        self.limits = write_through(of.groupBy(F.col("lang").alias("m_lang")).agg(*agg)
                                    .select("m_lang", "mean", lower.alias("lower"), upper.alias("upper")), "lm-limits")

    def _score(self):
        m = F.coalesce("mean", F.lit(self.mean))
        return F.when(F.col("n_symbols") > 0, (F.col("nll") + PRIOR * m) / (F.col("n_symbols") + PRIOR))

    def decide(self, scored: DataFrame) -> DataFrame:
        """Adds score, lower, upper and kept to rows with lang, nll and n_symbols (limits: one row a language)."""
        r = scored.join(self.limits, F.col("lang").eqNullSafe(F.col("m_lang")), "left") \
            .withColumn("score", self._score()) \
            .withColumn("lower", F.coalesce("lower", F.lit(self.lower))) \
            .withColumn("upper", F.coalesce("upper", F.lit(self.upper)))
        return r.withColumn("kept", F.coalesce(F.col("score").between(F.col("lower"), F.col("upper")), F.lit(False)))


def classify(docs: DataFrame, labels: DataFrame, **limits: float) -> DataFrame:
    """One row per document: doc_id, lang, n_symbols, score, perplexity, lower, upper, kept.

    ``score`` is the shrunk mean negative log-probability a symbol, perplexity
    its exponential; a document is kept if its score lies between its
    language's trusted quantiles ``low`` and ``high``, each moved out by
    ``slack``.  A language without trusted texts (null is a language of its
    own) takes the quantiles of all trusted texts; without any trusted text
    every document that isn't empty is kept.  Null text counts as empty; an
    empty text has perplexity null and isn't kept.  Repeated rows are scored
    alike; an empty table gives an empty result; other columns are ignored.
    """
    j = Judge(docs.select("doc_id", "lang", "text"), labels, **limits)
    return j.decide(j.rows).select(
        F.when(F.col("k_id") != F.lit(NULL_ID), F.col("k_id")).alias("doc_id"), "lang", "n_symbols", "score",
        F.exp("score").alias("perplexity"), "lower", "upper", "kept")


def keep(docs: DataFrame, labels: DataFrame, **limits: float) -> DataFrame:
    """Rows of ``docs`` that ``classify`` keeps, with all columns of ``docs`` and no other; no text is shuffled for it."""
    blocks = (j := Judge(docs, labels, **limits)).blocks
    scored = score(blocks, j.grams, blocks.columns).withColumn("lang", F.col(blocks.lang).cast("string"))
    return j.decide(scored).filter("kept").select(*[F.col(c).alias(n) for c, n in zip(blocks.columns, blocks.names)])
