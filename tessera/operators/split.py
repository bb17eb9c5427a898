"""Train / test split (TRN1) by a hash of the row key, so the split does
not depend on partitioning or on the order rows arrive in.

Plain split: row goes to test when ``md5(key) mod 10^6 < fraction * 10^6``.
Stratified split: within each class, the rows with the smallest hashes go
to test, ``ceil(fraction * n_class)`` of them. The per-class hash threshold
comes from a byte-wise radix selection: four passes that count rows per
class and byte, each joined with what the passes before have settled. The
classes stay a table, so their number is not limited, and no class is ever
gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import as_list
from tessera.functions.exprs import md5_unit
from tessera.session import cut_lineage

SCALE = 1_000_000


def hash_fraction(keys) -> F.Column:
    return F.pmod(md5_unit(*as_list(keys)), F.lit(SCALE))


def split(df: DataFrame, keys, test_fraction: float = 0.25, stratify: str | None = None):
    """Return ``(train, test)``; deterministic for a given key."""
    if stratify is None:
        h = hash_fraction(keys)
        cut = F.lit(int(round(test_fraction * SCALE)))
        return df.where(h >= cut), df.where(h < cut)
    limits = class_thresholds(df.select(F.col(stratify).alias("__y"), md5_unit(*as_list(keys)).alias("__h")), test_fraction)
    limits = cut_lineage(limits.select(F.col("__y").alias("__class"), "__t"))
    marked = df.join(limits, F.col(stratify).eqNullSafe(F.col("__class")))
    is_test = md5_unit(*as_list(keys)) < F.col("__t")
    return tuple(marked.where(c).select(*[F.col(f"`{n}`") for n in df.columns]) for c in (~is_test, is_test))


def class_thresholds(yh: DataFrame, fraction: float) -> DataFrame:
    """(__y, __t) from rows (__y, __h): exactly ceil(fraction * n_class) rows
    of a class have a hash below __t (fewer only where 32-bit hashes collide
    on it); __t is 2^32 where the whole class is taken. A null class counts
    as one."""
    sizes = yh.groupBy("__y").agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.withColumn("__k", F.ceil(F.lit(float(fraction)) * F.col("__n")).cast("long"))
    state = sizes.where("__k < __n").select(F.col("__y").alias("__c"), "__k", F.lit(0).cast("long").alias("__prefix"),
                                            F.lit(0).cast("long").alias("__below"))
    upto = Window.partitionBy("__c").orderBy("__byte")        # at most 256 rows each
    for shift in (24, 16, 8, 0):
        left = yh.join(state, F.col("__y").eqNullSafe(F.col("__c"))
                       & (F.shiftright("__h", shift + 8) == F.col("__prefix")))
        byte = F.shiftright("__h", shift).bitwiseAND(F.lit(255))
        counts = left.groupBy("__c", "__k", "__prefix", "__below", byte.alias("__byte")).agg(F.count(F.lit(1)).alias("__m"))
        counts = counts.withColumn("__upto", F.col("__below") + F.sum("__m").over(upto))
        counts = counts.where("__upto > __k and __upto - __m <= __k")   # the first byte that passes k
        state = counts.select("__c", "__k", (F.col("__prefix") * 256 + F.col("__byte")).alias("__prefix"),
                              (F.col("__upto") - F.col("__m")).alias("__below"))
    whole = sizes.where("__k >= __n").select("__y", F.lit(1 << 32).alias("__t"))
    return state.select(F.col("__c").alias("__y"), F.col("__prefix").alias("__t")).unionByName(whole)
