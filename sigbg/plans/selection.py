"""Feature selection studies: correlation tables, pruning, name rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import select as sel
from ..sources.fixtures import CAND_SQL, EVT_SQL, cand, evt, with_views
from ..sources.tables import read_table
from .registry import register

CAND = with_views(CAND_SQL)
EVT = with_views(EVT_SQL)

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "mbc", "deltae", "score",
            "unit_price", "qty_tax"]
SELECT_THRESHOLD = 0.6


def _rounded(df, *cols, places=6):
    return df.withColumns({c: F.round(c, places) for c in cols})


def _feat(spark, sf):
    return cand(spark, sf).withColumn("unit_price", F.col("l_extendedprice") / F.col("l_quantity")) \
                          .withColumn("qty_tax", F.col("l_quantity") * F.col("l_tax"))


_FEAT_SQL = CAND.rstrip() + """,
feat AS (SELECT *, l_extendedprice / l_quantity AS unit_price, l_quantity * l_tax AS qty_tax FROM cand)"""


def _long_sql() -> str:
    parts = []
    for i, a in enumerate(FEATURES):
        for j in range(i + 1, len(FEATURES)):
            b = FEATURES[j]
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, {i} AS a_pos, {j} AS b_pos, "
                         f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r FROM feat")
    return "long AS (\n" + "\nUNION ALL ".join(parts) + ")"


_LONG = _FEAT_SQL + ",\n" + _long_sql()


@register("c1_pearson", CAND + "SELECT round(corr(mbc, deltae), 6) AS r FROM cand")
def c1_pearson(spark, sf):
    return _rounded(sel.pearson(cand(spark, sf), "mbc", "deltae"), "r")


@register("c2_corr_long", _LONG + "\nSELECT a, b, CAST(a_pos AS INTEGER) AS a_pos, CAST(b_pos AS INTEGER) AS b_pos, "
                                  "round(r, 6) AS r FROM long")
def c2_corr_long(spark, sf):
    return _rounded(sel.corr_long(_feat(spark, sf), FEATURES), "r")


# 60 columns with a tenth of the values missing, another tenth in each: all nine features at six offsets of the key,
# and six mixtures.  Column c<k> misses the rows whose (order key + line + k) leaves 0 modulo 10.
def _wide_exprs() -> list[str]:
    return [f"CASE WHEN (l_orderkey + l_linenumber + {k}) % 10 = 0 THEN NULL ELSE "
            f"CAST({FEATURES[k % 9]} AS DOUBLE) + {k // 9 + 1} * CAST({FEATURES[(k + k // 9 + 1) % 9]} AS DOUBLE) END AS c{k}"
            for k in range(60)]


_WIDE_SQL = _FEAT_SQL + ",\nwide AS (SELECT " + ", ".join(_wide_exprs()) + " FROM feat)"


@register("c2_corr_wide_nulls", _WIDE_SQL + "\nSELECT a, b, CAST(p AS INTEGER) AS a_pos, CAST(q AS INTEGER) AS b_pos, round(r, 6) AS r\nFROM ("
          "SELECT unnest([" + ", ".join(f"{{'a': 'c{i}', 'b': 'c{j}', 'p': {i}, 'q': {j}, 'r': corr(c{i}, c{j})}}"
                                        for i in range(60) for j in range(i + 1, 60)) + "], recursive := true) FROM wide)")
def c2_corr_wide_nulls(spark, sf):
    """C2 over 60 columns with missing values spread over the rows."""
    return _rounded(sel.corr_long(_feat(spark, sf).selectExpr(*_wide_exprs()), [f"c{k}" for k in range(60)]), "r")


@register("c3_top_abs_corr", _LONG + """
SELECT a, b, CAST(a_pos AS INTEGER) AS a_pos, CAST(b_pos AS INTEGER) AS b_pos, round(r, 6) AS r, abs(round(r, 6)) AS abs_r
FROM long ORDER BY abs(round(r, 6)) DESC, a_pos, b_pos LIMIT 10""")
def c3_top_abs_corr(spark, sf):
    # Rounded first: equal columns differ in the last digits by the order of summation, and ties go by position.
    return sel.top_abs_correlations(_rounded(sel.corr_long(_feat(spark, sf), FEATURES), "r"), 10)


@register("c4_near_duplicates", _LONG + """,
top AS (SELECT * FROM long WHERE abs(r) > 0.99999)
SELECT DISTINCT b AS feature FROM top WHERE b NOT IN (SELECT a FROM top)""")
def c4_near_duplicates(spark, sf):
    return sel.near_duplicates(sel.corr_long(_feat(spark, sf), FEATURES))


_FIT = "(({x}) LIKE '%mbc%' OR ({x}) LIKE '%deltae%')"


@register("c5_correlated_to_fit", _LONG + f"""
SELECT DISTINCT feature FROM (
  SELECT b AS feature FROM long WHERE abs(r) > {SELECT_THRESHOLD} AND {_FIT.format(x='a')} AND NOT {_FIT.format(x='b')}
  UNION ALL
  SELECT a AS feature FROM long WHERE abs(r) > {SELECT_THRESHOLD} AND {_FIT.format(x='b')} AND NOT {_FIT.format(x='a')})""")
def c5_correlated_to_fit(spark, sf):
    return sel.correlated_to_fit(sel.corr_long(_feat(spark, sf), FEATURES), SELECT_THRESHOLD)


_C6 = f"""SELECT DISTINCT CASE WHEN a LIKE '%bo0%' THEN b ELSE a END AS feature FROM long
WHERE abs(r) > {SELECT_THRESHOLD} AND NOT {_FIT.format(x='a')} AND NOT {_FIT.format(x='b')}"""


@register("c6_correlated_features", _LONG + "\n" + _C6)
def c6_correlated_features(spark, sf):
    return sel.correlated_features(sel.corr_long(_feat(spark, sf), FEATURES), SELECT_THRESHOLD)


@register("c7_apply_drops", _LONG + """
SELECT l_orderkey, l_linenumber, labels, mbc, deltae, channel, l_extendedprice, l_tax, score,
       unit_price, qty_tax
FROM feat""")
def c7_apply_drops(spark, sf):
    f = _feat(spark, sf)
    drops = sel.correlated_features(sel.corr_long(f, FEATURES), SELECT_THRESHOLD)
    return sel.apply_drops(f, drops, mandatory=["l_tax"])


@register("c8_score_pivot_corr", EVT + """
SELECT round(corr(ln(score / (1.0 - score + 1e-8) + 1e-8), mbc), 6) AS corr_mbc,
       round(corr(ln(score / (1.0 - score + 1e-8) + 1e-8), deltae), 6) AS corr_deltae
FROM evt""")
def c8_score_pivot_corr(spark, sf):
    return _rounded(sel.score_pivot_correlation(evt(spark, sf)), "corr_mbc", "corr_deltae")


# ---------------------------------------------------------------- names / rows

def _raw(spark, sf):
    o = read_table(spark, sf, "orders")
    return o.select(
        (F.col("o_orderstatus") == "F").cast("int").alias("o__isSignal"),
        F.col("o_orderkey").alias("o__orderkey"),
        F.col("o_custkey").alias("o__custkey"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(None)).otherwise(F.col("o_totalprice"))
         .alias("o__totalprice"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(float("nan"))).otherwise(F.col("o_totalprice") / 1000.0)
         .alias("o__kprice"),
        F.col("o_orderpriority").alias("o__priority"),
    )


@register("p2_p6_p7_raw_prep", """
WITH raw AS (
  SELECT CAST(o_orderstatus = 'F' AS INTEGER) AS o__isSignal, o_orderkey AS o__orderkey,
         o_custkey AS o__custkey,
         CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_totalprice END AS o__totalprice,
         CASE WHEN o_orderpriority = '5-LOW' THEN 'NaN'::DOUBLE ELSE o_totalprice / 1000.0 END AS o__kprice,
         o_orderpriority AS o__priority
  FROM orders)
SELECT o__isSignal AS o_isSignal, o__orderkey AS o_orderkey, o__totalprice AS o_totalprice, o__kprice AS o_kprice
FROM raw
WHERE o__isSignal IS NOT NULL AND o__orderkey IS NOT NULL AND o__totalprice IS NOT NULL
  AND o__kprice IS NOT NULL AND NOT isnan(o__kprice)""")
def p2_p6_p7(spark, sf):
    r = sel.prune_unwanted(_raw(spark, sf), ["cust", "priority"], label="o__isSignal")
    return sel.drop_missing(sel.normalise_names(r))


@register("p1_p3_p4_p5_projection", CAND + """
SELECT labels, CAST(mbc AS FLOAT) AS mbc, CAST(deltae AS FLOAT) AS deltae,
       [CAST(l_quantity AS FLOAT), CAST(l_extendedprice AS FLOAT), CAST(l_discount AS FLOAT),
        CAST(l_tax AS FLOAT)] AS features
FROM cand""")
def p1_p3_p4_p5(spark, sf):
    c = cand(spark, sf).withColumn("sample_weight", F.lit(1.0)).withColumn("row_index", F.col("l_linenumber")) \
                       .withColumn("mbcErr", F.abs("deltae"))
    c = sel.drop_suffix(sel.drop_containing(c))
    roles = sel.Roles(exclude=("channel", "l_orderkey", "l_linenumber", "score"))
    return sel.role_split(c, roles)


@register("j5_j6_pair_membership", _LONG + """,
hit AS (SELECT * FROM long WHERE abs(r) > 0.6),
lefts AS (SELECT DISTINCT a AS feature FROM hit),
rights AS (SELECT DISTINCT b AS feature FROM hit)
SELECT feature, CAST(feature IN (SELECT feature FROM rights) AS INTEGER) AS also_right FROM lefts""")
def j5_j6_pair_membership(spark, sf):
    """J6 (upper-triangle column pairs, generated from the schema) + J5 (semi / anti joins)."""
    long = sel.corr_long(_feat(spark, sf), FEATURES)
    hit = long.filter(F.abs("r") > SELECT_THRESHOLD)
    lefts = hit.select(F.col("a").alias("feature")).distinct()
    rights = hit.select(F.col("b").alias("feature")).distinct()
    both = lefts.join(rights, "feature", "left_semi").withColumn("also_right", F.lit(1))
    only = lefts.join(rights, "feature", "left_anti").withColumn("also_right", F.lit(0))
    return both.unionByName(only)
