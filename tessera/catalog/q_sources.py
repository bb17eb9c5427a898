"""SRC1-SRC8, SNK1-SNK2: every file written here is derived from the driver
tables by Spark, under the shared checkpoint folder."""

from pyspark.sql import functions as F

from tessera.catalog.common import docs_missing
from tessera.catalog.registry import register, table
from tessera.operators import profile as P
from tessera.sources import io as IO
from tessera.sources.stage import StageStore


# CSV integers come back 64-bit (pandas parity), whatever width they had
@register("src1_read_csv", oracle="""
SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer
""")
def src1_read_csv(spark, d):
    path = IO.export_csv(table(spark, d, "customer"), IO.scratch_path(spark, "src1"))
    return IO.read_table(spark, path, "csv")


@register("src2_read_json", oracle="SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def src2_read_json(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    path = IO.scratch_path(spark, "src2")
    o.write.json(path)
    return IO.read_table(spark, path, "json").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@register("src2_read_json_array", oracle="SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def src2_read_json_array(spark, d):
    """SRC2, files that are each one JSON array of records, of about 10,000 records."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    parts = max(1, o.count() // 10_000)
    record = F.to_json(F.struct(*o.columns))
    arrays = o.groupBy(F.pmod(F.xxhash64("o_orderkey"), F.lit(parts)).alias("part")).agg(
        F.concat(F.lit("["), F.array_join(F.collect_list(record), ","), F.lit("]")).alias("value"))
    path = IO.scratch_path(spark, "src2")
    arrays.write.partitionBy("part").text(path)
    return IO.read_table(spark, path, "json").select(*o.columns)


@register("src3_validate_table", oracle="SELECT * FROM nation")
def src3_validate_table(spark, d):
    return IO.validate_table(table(spark, d, "nation"))


@register("src4_drop_empty_columns", oracle="""
SELECT d.doc_id, l.quality, d.lang FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def src4_drop_empty_columns(spark, d):
    docs = table(spark, d, "documents")
    j = docs.join(table(spark, d, "labels"), "doc_id", "left")
    x = j.select("doc_id", "quality", F.when(F.col("n_chars") < 0, F.col("n_chars")).alias("neg_chars"), "lang")
    return IO.drop_empty_columns(x)


@register("src5_unique_columns", oracle="SELECT c_custkey AS k, c_name AS k_1, c_acctbal AS k_2 FROM customer")
def src5_unique_columns(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal").toDF("k", "k", "k")
    return IO.unique_columns(c)


@register("src6_preview", oracle="SELECT * FROM customer ORDER BY c_custkey LIMIT 20")
def src6_preview(spark, d):
    _n, _m, head = IO.preview(table(spark, d, "customer"), 20, keys="c_custkey")
    return head


@register("src6_counts", oracle="SELECT count(*) AS n_rows, 5 AS n_columns FROM customer")
def src6_counts(spark, d):
    n, m, _ = IO.preview(table(spark, d, "customer"), 20, keys="c_custkey")
    return spark.createDataFrame([(n, m)], "n_rows long, n_columns int")


@register("src7_stage_roundtrip", oracle="SELECT * FROM customer")
def src7_stage_roundtrip(spark, d):
    store = StageStore(spark, IO.scratch_path(spark, "stages"))
    store.save(table(spark, d, "customer"), "cleaned_dataset")
    return store.load("cleaned_dataset")


@register("src8_latest_stage", oracle="""
SELECT 'outlier_free_dataset' AS stage, * FROM (SELECT DISTINCT lang, source FROM documents)
""")
def src8_latest_stage(spark, d):
    store = StageStore(spark, IO.scratch_path(spark, "stages"))
    raw = table(spark, d, "documents").select("lang", "source")
    store.save(raw, "dataset")
    store.save(raw.dropDuplicates(), "outlier_free_dataset")
    name = store.latest()
    return store.load(name).select(F.lit(name).alias("stage"), "*")


@register("snk1_export_csv", oracle="SELECT * FROM part")
def snk1_export_csv(spark, d):
    p = table(spark, d, "part")
    path = IO.export_csv(p, IO.scratch_path(spark, "snk1"))
    return IO.read_table(spark, path, "csv", schema=p.schema)


@register("snk2_export_report", oracle="""
WITH dm AS (SELECT d.doc_id, l.quality, nullif(d.lang, 'de') AS lang FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT 'doc_id' AS column_name, count(*) FILTER (WHERE doc_id IS NULL) AS null_count FROM dm
UNION ALL SELECT 'quality', count(*) FILTER (WHERE quality IS NULL) FROM dm
UNION ALL SELECT 'lang', count(*) FILTER (WHERE lang IS NULL) FROM dm
""")
def snk2_export_report(spark, d):
    dm = docs_missing(spark, d).select("doc_id", "quality", "lang")
    path = IO.export_report({"missing_summary": P.missing_summary(dm), "null_counts": P.null_counts(dm)},
                            IO.scratch_path(spark, "report"))
    return spark.read.schema("column_name string, null_count long").json(f"{path}/null_counts")
