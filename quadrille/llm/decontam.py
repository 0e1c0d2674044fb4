"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import by_merge

#: Fixed masks: the offsets that a seed reads in a window of SPAN words; the words between may differ.
MASKS = ((0, 1, 2, 5, 7, 9), (0, 2, 3, 4, 8, 9), (0, 1, 4, 6, 8, 9))
SPAN = 10
#: In the verification an equal word counts 1 and a substituted one -2; an overlap needs so many equal words.
MISS, MIN_EQUAL, MIN_SHARE = -2, 10, 0.75
#: Up to so many benchmark seeds (some 30 bytes each, and 24 for the words of their items) both are broadcast; beyond, they are
#: joined by a shuffle.
BROADCAST_SEEDS = 1_000_000


def hashed_words(text: Column) -> Column:
    """Hashes of the words: runs of letters and digits, lower case."""
    found = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(found, lambda w: F.xxhash64(w))


def seeds(rows: DataFrame, *keep: str) -> DataFrame:
    """rows(h, ...) -> keep..., pos, mask, seed: a row for each window of SPAN words and each mask."""
    at = rows.filter(F.size("h") >= SPAN).withColumn("pos", F.explode(F.expr(f"sequence(0, size(h) - {SPAN})")))
    read = [F.struct(F.lit(m).alias("mask"), F.xxhash64(F.lit(m), *[F.get("h", F.col("pos") + o) for o in mask]).alias("seed")) for m, mask in enumerate(MASKS)]
    return at.select(*keep, "pos", F.inline(F.array(*read)))


def best_run(equal: Column) -> Column:
    """Of an array of booleans the run with the largest sum of 1 and MISS, the first of equals: struct(score, first, last, equal)."""
    state = "named_struct('i', 0, 'sum', 0, 'first', 0, 'hit', 0, 'best', named_struct('score', 0, 'first', 0, 'last', -1, 'equal', 0))"

    def step(s, e):
        fresh = s["sum"] <= 0
        total = F.when(fresh, 0).otherwise(s["sum"]) + F.when(e, 1).otherwise(MISS)
        first = F.when(fresh, s["i"]).otherwise(s["first"])
        hit = F.when(fresh, 0).otherwise(s["hit"]) + F.when(e, 1).otherwise(0)
        here = F.struct(total.alias("score"), first.alias("first"), s["i"].alias("last"), hit.alias("equal"))
        return F.struct((s["i"] + 1).alias("i"), total.alias("sum"), first.alias("first"), hit.alias("hit"), F.when(total > s["best"]["score"], here).otherwise(s["best"]).alias("best"))

    return F.aggregate(equal, F.expr(state), step, lambda s: s["best"])


def overlaps(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """Overlaps of docs with benchmark items: key, item, doc_start, item_start, n_words, n_equal.

    Seeds of both sides are joined.  A hit fixes an alignment of the item's words with the document's; along it the run of
    words with the best score is taken, so substituted words are tolerated.  It is an overlap if it has MIN_EQUAL equal
    words and they are MIN_SHARE of it.  Of several overlaps of a document with an item the one with most equal words
    stays, the first of equals.  Null and empty texts, and texts and items under SPAN words, have no overlap, as that has
    MIN_EQUAL equal words; rows with equal keys
    are one document whose texts are each aligned by their own hits, and likewise rows of an item; null is a key like any
    other on both sides; an empty table on either side gives no rows; other columns are ignored.
    """
    their = items.select(F.col(item).alias("item"), hashed_words(F.col(item_text)).alias("t")).filter(F.size("t") >= SPAN).withColumn("words", F.xxhash64("t"))
    theirs, names = their.select("words", "t").distinct(), their.select("item", "words").distinct()  # equal items are aligned once
    table = seeds(theirs.withColumnRenamed("t", "h").withColumn("n_words", F.size("h")), "words", "n_words").withColumnRenamed("pos", "item_pos")
    h = hashed_words(F.col(text)).alias("h")
    shift, low = F.col("pos") - F.col("item_pos"), F.greatest(F.lit(0), -F.col("shift"))
    part = F.slice("h", F.col("low") + F.col("shift") + 1, F.least(F.col("n_words"), F.size("h") - F.col("shift")) - F.col("low")).alias("part")
    # distinct() takes what an alignment needs of a document's words right where it is hit: further on no row carries the whole document
    if table.count() <= broadcast_seeds:  # an item has at most 3.4 times as many words as seeds, so the items are bounded too
        hits = seeds(docs.select(F.col(key).alias("key"), h), "key", "h").join(F.broadcast(table), ["mask", "seed"]).withColumn("shift", shift).withColumn("low", low)
        aligned = hits.select("key", "words", "shift", "low", part).distinct().join(F.broadcast(theirs), "words")
    else:
        # a row is known by its key, which can be null, and a hash of both
        ours = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(key), F.col(key).isNull(), F.coalesce(F.col(text), F.lit(""))).alias("row"), h)
        hits = seeds(ours, "key", "row").join(by_merge(table), ["mask", "seed"]).select("key", "row", "words", "n_words", shift.alias("shift")).distinct().withColumn("low", low)
        ours = by_merge(ours.select(F.col("key").alias("our_key"), F.col("row").alias("our_row"), "h"))
        aligned = hits.join(ours, (F.col("row") == F.col("our_row")) & F.col("key").eqNullSafe(F.col("our_key"))).select("key", "words", "shift", "low", part).distinct()
        aligned = aligned.join(by_merge(theirs), "words")
    equal = F.transform("part", lambda w, i: w == F.get("t", F.col("low") + i))
    found = aligned.select("key", "words", "shift", "low", best_run(equal).alias("run"))
    found = found.select(
        "key", "words",
        F.struct(
            F.col("run.equal").alias("n_equal"),
            (-(F.col("low") + F.col("run.first") + F.col("shift"))).alias("order"),
            (F.col("low") + F.col("run.first")).alias("item_start"),
            (F.col("run.last") - F.col("run.first") + 1).alias("n_words"),
        ).alias("run"),
    ).filter((F.col("run.n_equal") >= MIN_EQUAL) & (F.col("run.n_equal") >= MIN_SHARE * F.col("run.n_words")))
    best = found.groupBy("key", "words").agg(F.max("run").alias("run")).join(by_merge(names), "words")
    best = best.groupBy("key", "item").agg(F.max("run").alias("run"))
    return best.select(
        F.col("key").alias(key), F.col("item").alias(item), (-F.col("run.order")).cast("long").alias("doc_start"), F.col("run.item_start").cast("long").alias("item_start"),
        F.col("run.n_words").cast("long").alias("n_words"), F.col("run.n_equal").cast("long").alias("n_equal"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """docs without the rows whose text overlaps a benchmark item; equal texts share one verdict, null texts stay."""
    keyed = docs.withColumn("__text_key", F.md5(F.coalesce(F.col(text), F.lit(""))))
    bad = overlaps(keyed, items, key="__text_key", text=text).select("__text_key").distinct()
    return keyed.join(bad, "__text_key", "left_anti").select(*[keyed[f"`{c}`"] for c in docs.columns])
