"""Mixing sources to target weights: repetition rates and hash-seeded copies, native operations only.

Sources in code point order (null last) weigh 5, 2, 1 and so on in turn. They share ``share`` times
all words by weight; a target stops at ``most`` times its source's size and what is over is shared
again by weight until none is above. A document comes floor(rate) times plus once more with the
rate's fraction as probability, decided by a hash of its id: reruns agree, whatever the partitions.

Defined results: a null text has size 0; a null source is a source of its own; rows with one id get
equal draws (a null id is a value of its own); sources without words have target 0; other columns
are ignored by ``digest`` and kept by ``stage``; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cropwind.sources.paths import written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = "mix"
#: Hexadecimal digits of the digest that make the draw: 52 bits, exact in a double.
DIGITS = 13


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """``rank`` (from 0) by code point, null last: ranges are sorted apart and then offset."""
    order = [F.col("source").asc_nulls_last()]
    ranges = sources.repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    ranges = written(ranges, "mix-ranges")
    # One row for each range, no more than there are shuffle partitions.
    counts = ranges.groupBy("range").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("range", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    return ranges.join(offsets, "range").withColumn("rank", place + F.col("before")).drop("range", "before")


def rates(sized: DataFrame) -> DataFrame:
    """``source, source_size, target, rate`` from ``source, size``."""
    sources = written(ranked(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-sources")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("rank"), F.lit(len(WEIGHTS))) + 1).cast("int"))
    sources = sources.select("source", "source_size", weight.cast("long").alias("weight"))
    limit = F.lit(MOST) * F.col("source_size")
    level, capped = 0.0, -1
    while True:
        # Two sums and a count come to the driver in each round; a round caps at least one source more.
        above = limit < F.col("weight") * F.lit(level)
        row = sources.agg(
            F.sum("source_size").alias("all"), F.count(F.when(above, 1)).alias("capped"),
            F.sum(F.when(above, limit).otherwise(0.0)).alias("taken"), F.sum(F.when(~above, F.col("weight"))).alias("weight"),
        ).first()
        if row["capped"] == capped or not row["weight"]:
            break
        capped, level = row["capped"], (SHARE * row["all"] - row["taken"]) / row["weight"]
    target = F.least(limit, F.col("weight") * F.lit(level))
    return sources.select("source", "source_size", target.alias("target"), F.try_divide(target, F.col("source_size").cast("double")).alias("rate"))


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) from the id alone."""
    text = F.concat(F.lit(f"{SEED}|"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)


def copies(rate: Column, doc_id: Column) -> Column:
    rate = F.coalesce(rate, F.lit(0.0))
    whole = F.floor(rate)
    return (whole + F.when(draw(doc_id) < rate - whole, 1).otherwise(0)).cast("long")


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document."""
    sized = written(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "mix-sizes")
    plan = rates(sized).withColumnRenamed("source", "of")
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("of")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("rate"), F.col("doc_id"))).alias("taken"))


def stage(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    plan = rates(docs.select("source", words(F.col("text")).alias("size")))
    plan = plan.select(F.col("source").alias("mix_of"), F.col("rate").alias("mix_rate"))
    named = docs.select(*(F.col(f"`{c}`").alias(c if c in ("doc_id", "source") else f"in_{i}") for i, c in enumerate(docs.columns)))
    rows = named.join(plan, F.col("source").eqNullSafe(F.col("mix_of")))
    rows = rows.withColumn("mix_copies", copies(F.col("mix_rate"), F.col("doc_id"))).where("mix_copies > 0")
    rows = rows.withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))))
    return rows.select(*(F.col(n).alias(c) for n, c in zip(named.columns, docs.columns, strict=True)))


SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source
), filled AS (
  -- With the k sources of the lowest limit per weight capped, the level of the others.
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER before, 0)) / sum(weight) OVER rest AS level
  FROM sources
  WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         rest AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), settled AS (
  SELECT min_by(level, source_size / weight) AS level FROM filled WHERE 2.0 * source_size >= level * weight
), plan AS (
  SELECT source, source_size, least(2.0 * source_size, weight * level) AS target FROM sources, settled
), rated AS (
  SELECT doc_id, size, source_size, target, coalesce(target / nullif(source_size, 0), 0) AS rate,
         ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 AS draw
  FROM sized JOIN plan ON sized.source IS NOT DISTINCT FROM plan.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""
