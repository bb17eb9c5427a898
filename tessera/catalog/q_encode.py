"""ENC1-ENC11 over ``part`` (64 names, 25 brands, 6 types with hint words)
and ``orders``."""

from pyspark.sql import functions as F

from tessera.catalog.common import round_doubles
from tessera.catalog.registry import register, table
from tessera.functions.exprs import md5_bucket
from tessera.operators import encode as E


def part_cats(spark, d):
    p = table(spark, d, "part")
    return p.select(
        "p_partkey", "p_name",
        F.when(F.col("p_brand") != "Brand#11", F.col("p_brand")).alias("p_brand"),
        "p_type", F.substring("p_brand", 7, 1).alias("brand_group"),
        F.when(F.col("p_size") <= 25, "small").otherwise("big").alias("size_band"),
        "p_size", "p_retailprice")


PC = """WITH pc AS (
  SELECT p_partkey, p_name, nullif(p_brand, 'Brand#11') AS p_brand, p_type,
         substr(p_brand, 7, 1) AS brand_group,
         CASE WHEN p_size <= 25 THEN 'small' ELSE 'big' END AS size_band,
         p_size, p_retailprice
  FROM part)
"""
TRAIN = "(SELECT * FROM pc WHERE ('0x' || substr(md5(CAST(p_partkey AS VARCHAR)), 1, 8))::BIGINT % 100 >= 25)"
TEST = "(SELECT * FROM pc WHERE ('0x' || substr(md5(CAST(p_partkey AS VARCHAR)), 1, 8))::BIGINT % 100 < 25)"


def _samples(c, rel="pc"):
    return (f"(SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM {rel} "
            f"WHERE {c} IS NOT NULL ORDER BY v LIMIT 5))")


def _advice_sql(c, dtype, rec_sql, is_target=False, numeric=False):
    needs = "false" if (is_target or numeric) else "true"
    rec = "'none'" if (is_target or numeric) else rec_sql
    samples = f"(SELECT string_agg(CAST(v AS VARCHAR), ', ' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM pc WHERE {c} IS NOT NULL ORDER BY v LIMIT 5))"
    return (f"SELECT '{c}' AS column_name, '{dtype}' AS dtype, count(DISTINCT {c}) AS n_unique, "
            f"{str(is_target).lower()} AS is_target, {needs} AS needs_encoding, {rec} AS recommended, "
            f"{samples} AS sample_values FROM pc")


_HINTS = ("'low', 'medium', 'high', 'very low', 'very high', 'small', 'large', 'poor', 'fair', 'good', "
          "'excellent', 'never', 'rarely', 'sometimes', 'often', 'always', 'none', 'some', 'most', 'all', "
          "'grade', 'level', 'rank', 'tier', 'class'")


def _rec_sql(c, rule="analysis"):
    hint = f"WHEN bool_or(lower(trim({c})) IN ({_HINTS})) THEN 'ordinal' " if rule == "analysis" else ""
    return (f"(SELECT CASE WHEN count(DISTINCT {c}) = 2 THEN 'label' {hint}"
            f"WHEN count(DISTINCT {c}) <= 10 THEN 'onehot' WHEN count(DISTINCT {c}) <= 50 THEN 'ordinal' "
            f"ELSE 'frequency' END FROM pc)")


_TEXT = ["p_name", "p_brand", "p_type", "brand_group", "size_band"]


@register("enc1_encoding_advice_column", oracle=PC + _advice_sql("p_type", "string", _rec_sql("p_type")))
def enc1_encoding_advice_column(spark, d):
    return E.encoding_profile_column(part_cats(spark, d), "p_type", target="p_size")


@register("enc2_encoding_advice", oracle=PC + "\nUNION ALL\n".join(
    [_advice_sql("p_partkey", "bigint", None, numeric=True)]
    + [_advice_sql(c, "string", _rec_sql(c)) for c in _TEXT]
    + [_advice_sql("p_size", "int", None, is_target=True),
       _advice_sql("p_retailprice", "double", None, numeric=True)]))
def enc2_encoding_advice(spark, d):
    return E.encoding_profile(part_cats(spark, d), target="p_size")


def _codes_cte(c, rel="pc", name=None):
    name = name or f"codes_{c}"
    return (f"{name} AS (SELECT v, (row_number() OVER (ORDER BY v) - 1)::INTEGER AS code "
            f"FROM (SELECT DISTINCT coalesce({c}, 'None') AS v FROM {rel}))")


@register("enc3_ordinal", oracle=PC + ", " + _codes_cte("p_brand") + """
SELECT p_partkey, k.code AS p_brand FROM pc JOIN codes_p_brand k ON coalesce(pc.p_brand, 'None') = k.v
""")
def enc3_ordinal(spark, d):
    pc = part_cats(spark, d).select("p_partkey", "p_brand")
    return E.encode(pc, {"p_brand": "ordinal"})


def _onehot_sql(c, rel="pc", cats_rel="pc"):
    return f"""(SELECT list(v ORDER BY v) FROM (SELECT DISTINCT coalesce({c}, 'None') AS v FROM {cats_rel}))"""


@register("enc4_onehot", oracle=PC + """
SELECT p_partkey,
  (p_type = 'LARGE')::DOUBLE AS p_type_LARGE, (p_type = 'MEDIUM')::DOUBLE AS p_type_MEDIUM,
  (p_type = 'PROMO')::DOUBLE AS p_type_PROMO, (p_type = 'SMALL')::DOUBLE AS p_type_SMALL,
  (p_type = 'STANDARD')::DOUBLE AS p_type_STANDARD
FROM pc
""")
def enc4_onehot(spark, d):
    pc = part_cats(spark, d).select("p_partkey", "p_type")
    return E.encode(pc, {"p_type": "onehot"})


@register("enc5_frequency", oracle=PC + """
, f AS (SELECT p_brand AS v, count(*) / (SELECT count(p_brand) FROM pc) AS share
        FROM pc WHERE p_brand IS NOT NULL GROUP BY p_brand)
SELECT p_partkey, round(coalesce(f.share, 0.0), 6) AS p_brand FROM pc LEFT JOIN f ON pc.p_brand = f.v
""")
def enc5_frequency(spark, d):
    pc = part_cats(spark, d).select("p_partkey", "p_brand")
    return round_doubles(E.encode(pc, {"p_brand": "frequency"}))


@register("enc6_binary", oracle=PC + """
, firsts AS (SELECT p_type AS v, min(p_partkey) AS first FROM pc GROUP BY p_type),
  codes AS (SELECT v, (row_number() OVER (ORDER BY first, v) - 1)::INTEGER AS code FROM firsts)
SELECT p_partkey, (code >> 0) & 1 AS p_type_bit0, (code >> 1) & 1 AS p_type_bit1, (code >> 2) & 1 AS p_type_bit2
FROM pc JOIN codes ON pc.p_type = codes.v
""")
def enc6_binary(spark, d):
    pc = part_cats(spark, d).select("p_partkey", "p_type")
    return E.encode(pc, {"p_type": "binary"}, order_key="p_partkey")


# ENC7: Encoder fitted on the training side with advised methods
# (brand_group 9 -> onehot, size_band 2 -> label, p_brand 24 -> ordinal,
# p_type hint words -> ordinal, p_name 64 -> frequency); replayed on all rows.
@register("enc7_encoder_fit_transform", oracle=PC + ", "
          + _codes_cte("p_brand", TRAIN, "cb") + ", " + _codes_cte("p_type", TRAIN, "ct") + ", "
          + _codes_cte("size_band", TRAIN, "cs") + f"""
, fq AS (SELECT p_name AS v, count(*) / (SELECT count(p_name) FROM {TRAIN}) AS share
         FROM {TRAIN} GROUP BY p_name)
SELECT pc.p_partkey, round(coalesce(fq.share, 0.0), 6) AS p_name,
       coalesce(cb.code, -1) AS p_brand, coalesce(ct.code, -1) AS p_type,
       coalesce(cs.code, -1) AS size_band,
       """ + ", ".join(f"(brand_group = '{g}')::DOUBLE AS brand_group_{g}" for g in "23456789") + """,
       pc.p_size
FROM pc
LEFT JOIN fq ON pc.p_name = fq.v
LEFT JOIN cb ON coalesce(pc.p_brand, 'None') = cb.v
LEFT JOIN ct ON pc.p_type = ct.v
LEFT JOIN cs ON pc.size_band = cs.v
""")
def enc7_encoder_fit_transform(spark, d):
    pc = part_cats(spark, d).select("p_partkey", "p_name", "p_brand", "p_type", "brand_group",
                                    "size_band", "p_size")
    train = pc.where(md5_bucket("p_partkey", 100) >= 25)
    model = E.Encoder({"target": "p_size"}).fit(train)
    return round_doubles(model.transform(pc))


@register("enc8_encode_all_ordinal", oracle=PC + ", " + ", ".join(_codes_cte(c) for c in _TEXT) + """
SELECT pc.p_partkey, """ + ", ".join(f"k_{c}.code::DOUBLE AS {c}" for c in _TEXT) + """,
       pc.p_retailprice, pc.p_size
FROM pc """ + " ".join(f"JOIN codes_{c} k_{c} ON coalesce(pc.{c}, 'None') = k_{c}.v" for c in _TEXT))
def enc8_encode_all_ordinal(spark, d):
    enc, _ = E.encode_all_ordinal(part_cats(spark, d), target="p_size")
    return enc


@register("enc9_train_test_ordinal", oracle=PC + f"""
, tc AS (SELECT v, (row_number() OVER (ORDER BY v) - 1)::BIGINT AS code
         FROM (SELECT DISTINCT p_brand AS v FROM {TRAIN} WHERE p_brand IS NOT NULL)),
  both_sides AS (SELECT 'train' AS side, * FROM {TRAIN} UNION ALL SELECT 'test' AS side, * FROM {TEST})
SELECT side, p_partkey::DOUBLE AS p_partkey, coalesce(tc.code, -1) AS p_brand,
       p_retailprice::DOUBLE AS p_retailprice
FROM both_sides LEFT JOIN tc ON both_sides.p_brand = tc.v
""")
def enc9_train_test_ordinal(spark, d):
    pc = part_cats(spark, d).select("p_partkey", "p_brand", "p_retailprice")
    b = md5_bucket("p_partkey", 100)
    tr, te = E.encode_train_test(pc.where(b >= 25), pc.where(b < 25))
    return (tr.select(F.lit("train").alias("side"), "*")
              .unionByName(te.select(F.lit("test").alias("side"), "*")))


@register("enc10_recommend_pipeline", oracle=PC + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, {_rec_sql(c, 'pipeline')} AS recommended" for c in _TEXT))
def enc10_recommend_pipeline(spark, d):
    rec = E.recommend_encoding(part_cats(spark, d), target="p_size", rule="pipeline")
    return spark.createDataFrame(sorted(rec.items()), "column_name string, recommended string")


@register("enc11_encode_target", oracle="""
WITH k AS (SELECT v, (row_number() OVER (ORDER BY v) - 1)::INTEGER AS code
           FROM (SELECT DISTINCT o_orderpriority AS v FROM orders))
SELECT o_orderkey, k.code AS o_orderpriority FROM orders JOIN k ON orders.o_orderpriority = k.v
""")
def enc11_encode_target(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    enc, _classes = E.encode_target(o, "o_orderpriority")
    return enc
