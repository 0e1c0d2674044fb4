"""Mixing sources to target weights by capped water-filling."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, cut

#: Up to so many sources their parameters are broadcast; beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 10_000
BUCKET_DIGITS = 3


def source_targets(sizes: DataFrame, weights=(1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """sizes(source, source_size) -> source, source_size, weight, target.

    Sources are ranked by code point, null last, and weigh weights[rank % len(weights)].  The water level is raised until
    no source is above max_epochs times its size: each round is one aggregate over the source table, and only its three
    numbers reach the driver.
    """
    spark = sizes.sparkSession
    ordered = sizes.orderBy(F.col("source").asc_nulls_last())
    ranked = spark.createDataFrame(
        ordered.rdd.zipWithIndex().map(lambda x: (x[0]["source"], x[0]["source_size"], x[1])), "source string, source_size long, rank long"
    )
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = cut(ranked.select("source", "source_size", weight.alias("weight")), "mix-sources")
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level = 0.0
    while True:
        over = cap < F.lit(level) * F.col("weight")
        capped, total, free = table.agg(
            F.sum(F.when(over, F.col("source_size"))), F.sum("source_size"), F.sum(F.when(~over, F.col("weight")))
        ).first()
        raised = ((total or 0) - max_epochs * (capped or 0)) / free if free else level
        if raised <= level:
            break
        level = raised
    return table.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def mix_sources(docs: DataFrame, weights=(1, 2, 3), max_epochs: int = 3, seed: str = "mix", text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """One row for each row of docs: key, source, size, source_size, target, repeats, taken.

    Every document of a source is repeated floor(target / source_size) times.  For the fraction that is left, documents are
    taken in the order of a seeded digest of their key until the middle of the next one would pass the target, so a source
    misses its target by half a document at most.  Rows with equal keys and sizes are interchangeable.  Null or empty texts
    have size 0 and are never taken; an empty table gives no rows; a source whose size is 0 has target 0.  Other columns
    are ignored, whatever their names.
    """
    sized = cut(
        docs.select(
            F.col(key).alias("key"),
            F.col(source).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null")))).alias("draw"),
        ),
        "mix-sized",
    )
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = cut(targets.withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    few = targets.count() <= BROADCAST_SOURCES
    small = F.broadcast if few else (lambda df: df)

    bucket = F.substring("draw", 1, BUCKET_DIGITS)
    sums = sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("held"))
    before = F.sum("held").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    filled = sums.withColumn("before", F.coalesce(before, F.lit(0)))
    edge = (
        filled.alias("f").join(small(targets.alias("t")), F.expr("f.source <=> t.source"))
        .filter((F.col("before") < F.col("need")) & (F.col("before") + F.col("held") >= F.col("need")))
        .groupBy("f.source").agg(F.min("bucket").alias("edge"), F.min_by("before", "bucket").alias("before"))
    )
    plan = cut(
        targets.alias("t").join(edge.alias("e"), F.expr("t.source <=> e.source"), "left")
        .select("t.*", F.coalesce("edge", F.lit("")).alias("edge"), F.coalesce("before", F.lit(0)).alias("before")),
        "mix-plan",
    )
    rows = sized.alias("d").join(small(plan.alias("p")), F.expr("d.source <=> p.source")).select("d.*", "source_size", "target", "whole", "need", "edge", "before").withColumn("bucket", bucket)
    at = F.col("bucket") == F.col("edge")
    run = F.sum("size").over(Window.partitionBy("source").orderBy("draw", "size", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = rows.filter(at).withColumn("extra", F.col("before") + run - F.col("size") / 2 <= F.col("need"))
    outside = rows.filter(~at).withColumn("extra", F.col("bucket") < F.col("edge"))
    repeats = F.col("whole") + F.when(F.col("extra"), 1).otherwise(0)
    return inside.unionByName(outside).select(
        F.col("key").alias(key), "source", "size", "source_size", "target", repeats.cast("long").alias("repeats"), (repeats * F.col("size")).cast("long").alias("taken")
    )
