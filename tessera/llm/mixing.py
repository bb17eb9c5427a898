"""Mixing sources to target weights by a low-discrepancy schedule.

Every source is its documents in shuffled order (by md5 of the id), cut into
blocks of equally many words. The schedule is a sequence of slots. Slot ``i``
has the golden-ratio point ``frac(i * phi)`` (as 32-bit integers, exact);
the sources' targets, laid side by side, map that point to a source. A slot's
rank among its source's slots names the block it takes; after the last block a
source starts anew, until it has given its target's words. So every stretch of
the schedule holds the sources near their target shares.

Only DataFrame functions are used, and no source is ever in one task: running
sums go in two steps, over 4,096 hash buckets of a source's documents and over
stretches of 16,384 slots.

Defined results: null or empty texts have size 0 and are never taken; a null
source is a source of its own and sorts last; a null id is shuffled like an
empty id; repeated rows are rows of their own; an empty table gives no rows. Of the
input only the id, text and source columns are read, so other columns may have
any names. Ties in the shuffled order go to the smaller id, then the smaller
size; rows alike in all of these are alike in the result up to their order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stage
from tessera.plans.ranks import global_row_number, running_totals

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)     # by a source's place in code point order, repeating
REPEATS = 3             # no document is taken more often
BLOCK = 512             # words of a slot
_POINTS = 1 << 32       # points are integers below this
_PHI = 2654435769       # 2^32 / golden ratio, odd
_CELL = 20              # a point's cell is its bits from here up
_STRETCH = 14           # slots numbered together: 2^14
_BUCKET_DIGITS = 3      # a source's documents go by the first hex digits: 4,096 buckets


@dataclass
class Mix:
    documents: DataFrame   # doc_id, source, size, source_size, target, src, at
    sources: DataFrame     # source, src, weight, source_size, target, words
    block: int


def _big(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def _targets(sources: DataFrame, repeats: int) -> DataFrame:
    """Adds target (double) and words (its whole words). With ``level`` the
    words of one unit of weight, a source gets min(repeats * size, level *
    weight). Newton's steps on the level: each takes one aggregate row, the
    capped sources only grow, and the first level that caps no other is right."""
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    free, share = int(total or 0), int(weights or 1)
    while True:
        capped = _big("source_size") * repeats * F.lit(share) < _big("weight") * F.lit(free)
        lost, rest = sources.agg(F.sum(F.when(capped, F.col("source_size") * repeats)),
                                 F.sum(F.when(~capped, F.col("weight")))).first()
        now = int(total or 0) - int(lost or 0), int(rest or 1)
        if now == (free, share):
            break
        free, share = now
    most, part = F.col("source_size") * repeats, f"cast(weight as long) * {free}L"
    return sources.withColumns({
        "target": F.when(capped, most.cast("double")).otherwise(
            F.expr(f"cast({part} as double) / cast({share} as double)")),
        "words": F.when(capped, most).otherwise(F.expr(f"({part}) div {share}L")).cast("long")})


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         weights=WEIGHTS, repeats: int = REPEATS, block: int = BLOCK) -> Mix:
    """Sizes, targets and every document's place (``at``) in the shuffled
    order of its source. The texts are read once."""
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    base = stage(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("h")))
    sources = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = global_row_number(sources.withColumn("none", F.col("source").isNull()),
                                ["none", "source"], out="src").drop("none")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("src") % len(weights)).cast("int") + 1)
    sources = stage(_targets(stage(sources.withColumn("weight", w)), repeats))
    rows = base.join(sources.select(F.col("source").alias("s"), "src", "source_size", "target"),
                     F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("bucket", F.substring("h", 1, _BUCKET_DIGITS))
    order = Window.partitionBy("src", "bucket").orderBy("h", "doc_id", "size")
    rows = rows.withColumn("inner", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    before = _before(rows.groupBy("src", "bucket").agg(F.sum("size").alias("v")), "bucket")
    rows = rows.join(before, ["src", "bucket"]).withColumn("at", F.col("before") + F.col("inner") - F.col("size"))
    return Mix(stage(rows.select("doc_id", "source", "size", "source_size", "target", "src", "at")), sources, block)


def _before(sums: DataFrame, by: str) -> DataFrame:
    """Sum of ``v`` over a source's earlier groups; ``sums`` has one row for each."""
    w = Window.partitionBy("src").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("src", by, F.coalesce(F.sum("v").over(w), F.lit(0)).alias("before"))


def _points(slots: DataFrame) -> DataFrame:
    """Golden-ratio point of each slot: slot * _PHI mod 2^32, in halves so
    that no product passes 64 bits."""
    low, high = F.col("slot") % 65536, F.shiftrightunsigned("slot", 16) % 65536
    return slots.withColumn("point", ((high * _PHI % _POINTS) * 65536 + low * _PHI) % _POINTS)


def slots(mix: Mix) -> DataFrame:
    """The schedule: slot, src, source, pass, block, words. ``pass`` counts how
    often the source has been gone through, ``words`` is the slot's length.
    Slots beyond a source's target are left out; what the sequence falls short
    of a target (a few slots) closes the schedule, source by source."""
    spark = mix.documents.sparkSession
    s = mix.sources.where("words > 0")
    total = int(s.agg(F.sum("words")).first()[0] or 0)
    n = -(-total // mix.block)
    # a pass is ceil(size / block) slots, the last pass may be cut short
    s = s.withColumn("blocks", F.expr(f"source_size div {mix.block} + if(source_size % {mix.block} > 0, 1, 0)"))
    s = s.withColumns({"whole": F.expr("words div source_size"), "rest": F.expr("words % source_size")})
    s = s.withColumn("need", F.expr(f"whole * blocks + (rest + {mix.block - 1}) div {mix.block}"))
    edges = running_totals(s, ["src"], ["words"])
    edge = f"cast(%s as decimal(38,0)) * {_POINTS}L div {max(total, 1)}L"
    edges = edges.select("src", F.expr(edge % "(cum_words - words)").alias("low"), F.expr(edge % "cum_words").alias("high"))
    cells = edges.where("high > low").withColumn(
        "cell", F.explode(F.sequence(F.shiftright("low", _CELL), F.shiftright(F.col("high") - 1, _CELL))))
    got = _points(spark.range(n).withColumnRenamed("id", "slot"))
    got = got.withColumn("cell", F.shiftright("point", _CELL)).join(cells, "cell").where("point >= low and point < high")
    got = got.select("src", "slot", F.shiftright("slot", _STRETCH).alias("stretch"))
    order = Window.partitionBy("src", "stretch").orderBy("slot")
    ranked = got.withColumn("inner", F.row_number().over(order) - 1)
    counts = got.groupBy("src", "stretch").agg(F.count(F.lit(1)).alias("v"))
    ranked = ranked.join(_before(counts, "stretch"), ["src", "stretch"]).select(
        "src", "slot", (F.col("inner") + F.col("before")).alias("rank"))
    made = counts.groupBy("src").agg(F.sum("v").alias("made"))
    short = s.join(made, "src", "left").withColumn("made", F.coalesce("made", F.lit(0))).where("made < need")
    closing = short.select("src", F.explode(F.sequence("made", F.col("need") - 1)).alias("rank"))
    ranked = ranked.unionByName(closing.withColumn("slot", F.col("rank") + n))
    ranked = ranked.join(s, "src").where("rank < need")
    ranked = ranked.withColumns({"pass": F.expr("rank div blocks"), "block": F.expr("rank % blocks")})
    end = F.when(F.col("pass") == F.col("whole"), F.col("rest")).otherwise(F.col("source_size"))
    return ranked.select("slot", "src", "source", "pass", "block",
                         F.least(F.lit(mix.block), end - F.col("block") * mix.block).cast("long").alias("words"))


def mixed(mix: Mix) -> DataFrame:
    """The mix: one row per slot and document in it, in order of (slot,
    source, place): slot, source, pass, doc_id, start (words of the document
    before), length (its words here), place (words of the slot before), and
    src, at, which name the document's row."""
    b = mix.block
    d = mix.documents.where("size > 0").select("doc_id", "src", "at", "size", F.explode(F.sequence(
        F.expr(f"at div {b}"), F.expr(f"(at + size - 1) div {b}"))).alias("block"))
    d = d.withColumn("first", F.greatest(F.col("at"), F.col("block") * b))
    d = d.select("doc_id", "src", "at", "block", (F.col("first") - F.col("at")).alias("start"),
                 (F.col("first") - F.col("block") * b).alias("place"),
                 (F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * b) - F.col("first")).alias("long"))
    got = slots(mix).join(d, ["src", "block"]).withColumn("length", F.least("long", F.col("words") - F.col("place")))
    return got.where("length > 0").select("slot", "source", "pass", "doc_id", "start", "length", "place", "src", "at")


def taken(mix: Mix) -> DataFrame:
    """Every document with the words the mix takes of it: doc_id, size,
    source_size, target, taken."""
    sums = mixed(mix).groupBy("src", "at").agg(F.sum("length").alias("got"))
    got = mix.documents.join(sums, ["src", "at"], "left")
    return got.select("doc_id", "size", "source_size", "target",
                      F.when(F.col("size") > 0, F.coalesce("got", F.lit(0))).otherwise(0).cast("long").alias("taken"))


# The same words in SQL: a source's whole passes, and the start of its
# shuffled order up to what is left of its target.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (
  SELECT source, sum(size)::HUGEINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, (SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) OVER
              (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free,
         sum(w) OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST
                      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share,
         row_number() OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST) AS k FROM s),
level AS (SELECT free, share FROM o WHERE 3 * source_size * share >= free * w ORDER BY k LIMIT 1),
t AS (
  SELECT s.source, source_size, 3 * source_size * share < free * w AS capped,
         CASE WHEN 3 * source_size * share < free * w THEN (3 * source_size)::DOUBLE
              ELSE (free * w)::DOUBLE / share::DOUBLE END AS target,
         (CASE WHEN 3 * source_size * share < free * w THEN 3 * source_size ELSE (free * w) // share END)::BIGINT AS words
  FROM s, level),
p AS (
  SELECT d.*, t.source_size::BIGINT AS source_size, target, words,
         sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE (words // source_size) * size
            + greatest(0, least(place + size, words % source_size) - place) END::BIGINT AS taken
FROM p
"""
