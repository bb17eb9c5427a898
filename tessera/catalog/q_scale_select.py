"""SCL1-SCL7 and SEL2-SEL5, SEL12-SEL16."""

from pyspark.sql import functions as F

from tessera.catalog.common import round_doubles
from tessera.catalog.q_encode import PC, part_cats
from tessera.catalog.registry import register, table
from tessera.functions.exprs import md5_bucket
from tessera.operators import scale as S
from tessera.operators import select as SEL

NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _li(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *NUMS, "l_returnflag")


def _scale_sql(center, scale):
    cols = ", ".join(
        f"round((x.{c} - {center(c)}) / coalesce(nullif({scale(c)}, 0), 1), 6) AS {c}" for c in NUMS)
    return f"SELECT l_orderkey, l_linenumber, {cols}, l_returnflag FROM lineitem x"


@register("scl1_standard", oracle=_scale_sql(lambda c: f"(SELECT avg({c}) FROM lineitem)",
                                             lambda c: f"(SELECT stddev_pop({c}) FROM lineitem)"))
def scl1_standard(spark, d):
    return round_doubles(S.scale(_li(spark, d), NUMS, "standard"))


@register("scl2_minmax", oracle=_scale_sql(lambda c: f"(SELECT min({c}) FROM lineitem)",
                                           lambda c: f"(SELECT max({c}) - min({c}) FROM lineitem)"))
def scl2_minmax(spark, d):
    return round_doubles(S.scale(_li(spark, d), NUMS, "minmax"))


@register("scl3_robust", oracle=_scale_sql(
    lambda c: f"(SELECT quantile_cont({c}, 0.5) FROM lineitem)",
    lambda c: f"(SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM lineitem)"))
def scl3_robust(spark, d):
    return round_doubles(S.scale(_li(spark, d), NUMS, "robust"))


@register("scl4_scale_selected", oracle="""
SELECT round((l_quantity - (SELECT avg(l_quantity) FROM lineitem))
             / (SELECT stddev_pop(l_quantity) FROM lineitem), 6) AS l_quantity,
       round((l_discount - (SELECT avg(l_discount) FROM lineitem))
             / (SELECT stddev_pop(l_discount) FROM lineitem), 6) AS l_discount,
       l_returnflag, l_tax
FROM lineitem
""")
def scl4_scale_selected(spark, d):
    out, _info = S.scale_selected(_li(spark, d), ["l_quantity", "l_discount", "l_returnflag"],
                                  target="l_tax", method="standard")
    return round_doubles(out)


@register("scl5_recommend_scaler", oracle="""
WITH q AS (SELECT quantile_cont(n_chars, 0.25) AS a1, quantile_cont(n_chars, 0.75) AS a3,
                  quantile_cont(doc_id, 0.25) AS b1, quantile_cont(doc_id, 0.75) AS b3 FROM documents),
f AS (SELECT (count(*) FILTER (WHERE n_chars < a1 - 1.5 * (a3 - a1) OR n_chars > a3 + 1.5 * (a3 - a1))
                / count(*) > 0.05)::INT
           + (count(*) FILTER (WHERE doc_id < b1 - 1.5 * (b3 - b1) OR doc_id > b3 + 1.5 * (b3 - b1))
                / count(*) > 0.05)::INT AS flagged
      FROM documents, q)
SELECT CASE WHEN flagged / 2 > 0.3 THEN 'robust' ELSE 'standard' END AS recommended FROM f
""")
def scl5_recommend_scaler(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "lang")
    rec = S.recommend_scaler(docs, ["n_chars", "doc_id"], target="lang")
    return spark.createDataFrame([(rec,)], "recommended string")


_O_TRAIN = "(SELECT * FROM orders WHERE ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT % 100 >= 25)"


@register("scl6_fitted_scaler", oracle=f"""
SELECT o_orderkey,
       round((o_totalprice - (SELECT quantile_cont(o_totalprice, 0.5) FROM {_O_TRAIN}))
             / (SELECT quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) FROM {_O_TRAIN}), 6)
         AS o_totalprice,
       o_orderstatus
FROM orders
""")
def scl6_fitted_scaler(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    model = S.Scaler({"columns": ["o_totalprice"], "method": "robust"}).fit(
        o.where(md5_bucket("o_orderkey", 100) >= 25))
    return round_doubles(model.transform(o))


_H6 = "('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT % 1000000"


@register("scl7_scale_and_split", oracle=f"""
WITH tr AS (SELECT * FROM orders WHERE {_H6} >= 200000)
SELECT CASE WHEN {_H6} >= 200000 THEN 'train' ELSE 'test' END AS side, o_orderkey,
       round((o_totalprice - (SELECT avg(o_totalprice) FROM tr)) / (SELECT stddev_pop(o_totalprice) FROM tr), 6)
         AS o_totalprice,
       o_orderstatus
FROM orders
""")
def scl7_scale_and_split(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    tr, te = S.scale_and_split(o, ["o_totalprice"], "o_orderstatus", keys="o_orderkey", test_fraction=0.2)
    out = (tr.select(F.lit("train").alias("side"), "*")
             .unionByName(te.select(F.lit("test").alias("side"), "*")))
    return round_doubles(out)


# ---------------------------------------------------------------- selection
def _li_sel(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("order_id"), "l_linenumber", "l_quantity",
                     "l_discount", "l_tax", "l_extendedprice")


def _r(c, t, rel):
    return (f"(SELECT covar_pop({c}, {t}) / nullif(stddev_pop({c}) * stddev_pop({t}), 0) FROM {rel})")


_SEL_FEATS = ["l_linenumber", "l_quantity", "l_discount", "l_tax"]


@register("sel2_correlation_importance", oracle="""
WITH r AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {_r(c, 'l_extendedprice', 'lineitem')} AS correlation" for c in _SEL_FEATS) + """)
SELECT feature, round(correlation, 6) AS correlation, round(abs(correlation), 6) AS abs_correlation,
       round(abs(correlation) / (SELECT max(abs(correlation)) FROM r) * 100, 2) AS importance
FROM r WHERE correlation IS NOT NULL
""")
def sel2_correlation_importance(spark, d):
    out, _removed = SEL.correlation_importance(_li_sel(spark, d), "l_extendedprice")
    return out.select("feature", F.round("correlation", 6).alias("correlation"),
                      F.round("abs_correlation", 6).alias("abs_correlation"), "importance")


_PC_TEXT = ["p_name", "p_brand", "p_type", "brand_group", "size_band"]


def _pc_codes():
    return ", ".join(
        f"k_{c} AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code "
        f"FROM (SELECT DISTINCT coalesce({c}, 'None') AS v FROM pc))" for c in _PC_TEXT)


_PC_ENC = ("enc AS (SELECT pc.p_partkey, pc.p_size, pc.p_retailprice, "
           + ", ".join(f"k_{c}.code::DOUBLE AS {c}" for c in _PC_TEXT) + " FROM pc "
           + " ".join(f"JOIN k_{c} ON coalesce(pc.{c}, 'None') = k_{c}.v" for c in _PC_TEXT) + ")")


@register("sel3_correlation_with_target", oracle=PC + ", " + _pc_codes() + ", " + _PC_ENC + "\n"
          + " UNION ALL ".join(
              f"SELECT '{c}' AS feature, round(abs({_r(c, 'p_retailprice', 'enc')}), 6) AS score"
              for c in ["p_partkey", "p_size"] + _PC_TEXT))
def sel3_correlation_with_target(spark, d):
    return round_doubles(SEL.correlation_with_target(part_cats(spark, d), "p_retailprice"))


def _anova_sql(feats, target, rel):
    parts = []
    for c in feats:
        parts.append(f"""SELECT '{c}' AS feature, (
  SELECT (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*)))
  FROM (SELECT count(*) AS n, avg({c}) AS m, var_pop({c}) AS v FROM {rel} GROUP BY {target}) s,
       (SELECT avg({c}) AS g FROM {rel}) t) AS score""")
    return " UNION ALL ".join(parts)


def _rank_sql(scores_sql, k):
    return f"""SELECT feature, round(score, 6) AS score,
       (row_number() OVER (ORDER BY score DESC NULLS LAST, feature))::INTEGER AS rank,
       row_number() OVER (ORDER BY score DESC NULLS LAST, feature) <= {k} AS selected
FROM ({scores_sql})"""


_LK = "(SELECT l_quantity, l_discount, l_tax, (dense_rank() OVER (ORDER BY l_returnflag) - 1)::DOUBLE AS l_returnflag, l_linenumber, l_extendedprice FROM lineitem)"


@register("sel4_kbest_anova", oracle="WITH lk AS " + _LK + "\n" + _rank_sql(
    _anova_sql(["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_extendedprice"], "l_linenumber", "lk"), 2))
def sel4_kbest_anova(spark, d):
    li = table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag",
                                            "l_linenumber", "l_extendedprice")
    return round_doubles(SEL.kbest(li, "l_linenumber", k=2))


@register("sel5_kbest_regression", oracle="WITH lk AS " + _LK + "\n" + _rank_sql(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, r * r / (1 - r * r) * (n - 2) AS score FROM (SELECT covar_pop({c}, l_extendedprice) "
    f"/ nullif(stddev_pop({c}) * stddev_pop(l_extendedprice), 0) AS r, count(*) AS n FROM lk)"
    for c in ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linenumber"]), 3))
def sel5_kbest_regression(spark, d):
    li = table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag",
                                            "l_linenumber", "l_extendedprice")
    return round_doubles(SEL.kbest(li, "l_extendedprice", k=3))


@register("sel12_select_features", oracle=PC + ", " + _pc_codes() + ", " + _PC_ENC + "\n" + _rank_sql(
    " UNION ALL ".join(f"SELECT '{c}' AS feature, abs({_r(c, 'p_retailprice', 'enc')}) AS score"
                       for c in ["p_partkey", "p_size"] + _PC_TEXT), 3))
def sel12_select_features(spark, d):
    return round_doubles(SEL.select_features(part_cats(spark, d), "p_retailprice", "correlation", k=3))


@register("sel13_irrelevant_features", oracle="""
WITH x AS (SELECT l_linenumber, l_quantity, l_discount, l_tax, 1 AS one, l_extendedprice FROM lineitem),
r AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, (SELECT count(DISTINCT {c}) FROM x) AS nd, abs({_r(c, 'l_extendedprice', 'x')}) AS a"
    for c in ["l_linenumber", "l_quantity", "l_discount", "l_tax", "one"]) + """)
SELECT feature, CASE WHEN nd <= 1 THEN 'constant' ELSE 'low_correlation' END AS reason,
       round(a, 6) AS abs_correlation
FROM r WHERE nd <= 1 OR a < 0.05
""")
def sel13_irrelevant_features(spark, d):
    li = table(spark, d, "lineitem").select("l_linenumber", "l_quantity", "l_discount", "l_tax",
                                            F.lit(1).alias("one"), "l_extendedprice")
    return round_doubles(SEL.irrelevant_features(li, "l_extendedprice"))


@register("sel14_project_features", oracle="""
SELECT c_acctbal AS "Acct Bal", c_mktsegment AS market_segment, c_custkey AS "Customer Key" FROM customer
""")
def sel14_project_features(spark, d):
    cust = table(spark, d, "customer").select(
        F.col("c_custkey").alias("Customer Key"), F.col("c_mktsegment").alias("market_segment"),
        F.col("c_acctbal").alias("Acct Bal"), "c_name")
    return SEL.project_features(cust, ["acct bal", "Market Segment"], target="Customer Key")


@register("sel15_top_correlated", oracle="""
WITH r AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, abs({_r(c, 'l_extendedprice', 'lineitem')}) AS a"
    for c in ["l_linenumber", "l_quantity", "l_discount", "l_tax", "l_orderkey"]) + """)
SELECT (row_number() OVER (ORDER BY a DESC, feature))::INTEGER AS rank, feature FROM r
QUALIFY row_number() OVER (ORDER BY a DESC, feature) <= 2
""")
def sel15_top_correlated(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount",
                                            "l_tax", "l_extendedprice")
    names = SEL.top_correlated(li, "l_extendedprice", k=2, max_columns=50)
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], "rank int, feature string")


# top-1 |r| with l_extendedprice is l_discount (see sel15's oracle ranking)
@register("sel16_fitted_selector", oracle="""
SELECT l_discount, l_extendedprice FROM lineitem
""")
def sel16_fitted_selector(spark, d):
    li = table(spark, d, "lineitem").select("l_linenumber", "l_quantity", "l_discount", "l_tax",
                                            "l_extendedprice")
    model = SEL.Selector({"target": "l_extendedprice", "k": 1}).fit(li)
    return model.transform(li)
