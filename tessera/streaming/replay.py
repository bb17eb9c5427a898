"""Fitted transforms on streams (section 7.5 of the blueprint).

Every fitted stage here (imputer, encoder, selector, scaler, the whole
preprocessor, a trained model) transforms row by row with literals from
its state, so the same object applies to a streaming DataFrame. This
helper runs one through Structured Streaming with ``availableNow`` (all
input files, then stop), writing to a file sink with its checkpoint in the
shared checkpoint folder, so a restarted job resumes exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.io import scratch_path


def _is_file(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def replay_stream(spark: SparkSession, transform, source: str, schema, fmt: str = "parquet",
                  out_path: str | None = None, checkpoint: str | None = None,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """Apply ``transform`` (a fitted Model or a DataFrame -> DataFrame
    function) to a file stream and return the written result as a batch
    DataFrame."""
    reader = spark.readStream.schema(schema).format(fmt)
    if _is_file(spark, source):       # a single file: stream it through a one-file glob
        source = source[:-1] + "[" + source[-1] + "]"
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(source)
    out = transform.transform(stream) if hasattr(transform, "transform") else transform(stream)
    out_path = out_path or scratch_path(spark, "stream-out")
    checkpoint = checkpoint or scratch_path(spark, "stream-ckpt")
    q = (out.writeStream.format("parquet").option("path", out_path)
            .option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(out_path)
