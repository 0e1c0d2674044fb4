"""N-gram Jaccard join: MinHash candidates, pruned by the posterior probability of reaching the threshold, verified exactly.

Equal shingle sets are one class.  Classes that share a band of their signatures are tied to the least class of that
bucket, never to each other; within the components of these ties the pairs are compared in blocks inside tasks: signature
values 16 at a time, a pair being dropped as soon as the probability that it reaches the threshold is below the tolerance,
then the whole sets of those that are left.  No pair is ever a row: a block gives each class its number of links and a
spanning forest of them.
"""

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, join_uneven, lean, mix, offsets, ranges, utf8, words
from ..operators.graph import components

N_WORDS, THRESHOLD = 5, 0.8
#: A pair of the threshold's similarity shares no band with probability (1 - 0.8**6)**42, 3 in a million.
BANDS, BAND_ROWS = 42, 6
K, STEP = BANDS * BAND_ROWS, 16
#: A pair is dropped when the posterior probability that it reaches the threshold is lower.
TOLERANCE = 1e-5
#: Classes and shingles in a block at most, on average.
BLOCK_CLASSES, BLOCK_SHINGLES = 2048, 2_000_000

_RNG = np.random.default_rng(20240229)
_A = (_RNG.integers(0, 1 << 31, K, dtype=np.uint32) << np.uint32(1) | np.uint32(1))[:, None]
_B = _RNG.integers(0, 1 << 32, K, dtype=np.uint32)[:, None]
_BAND = mix(np.arange(1, K + 1, dtype=np.uint64)).reshape(BANDS, BAND_ROWS) | np.uint64(1)


@functools.cache
def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """After how many compared values how many must agree: below, the posterior of a similarity from `threshold` up, with a
    uniform prior, is under the tolerance."""
    s = (np.arange(20_000) + 0.5) / 20_000
    out = {}
    for n in range(STEP, K + 1, STEP):
        for m in range(n + 1):
            logs = m * np.log(s) + (n - m) * np.log1p(-s)
            mass = np.exp(logs - logs.max())
            if mass[s >= threshold].sum() / mass.sum() >= tolerance:
                break
        out[n] = m
    return out


def shingle_sets(texts, n: int = N_WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of the runs of n words of each text; fewer words than n are one run of their own."""
    hashes, counts = words(utf8(texts))
    starts = offsets(counts)[:-1]
    runs = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    padded = np.concatenate([hashes, np.zeros(n, np.uint64)])
    first = ranges(starts, runs)
    left = np.repeat(starts + counts, runs)
    value = np.zeros(len(first), np.uint64)
    for k in range(n):
        word = np.where(first + k < left, padded[first + k], np.uint64(0))
        value = mix(value + word + np.uint64(k + 1))
    at = offsets(runs)
    return [np.unique(value[at[i] : at[i + 1]]) for i in range(len(texts))]


def signature(found: np.ndarray) -> np.ndarray:
    """K MinHash values of a set that is not empty."""
    low = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(K, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 1024):
        part = _A * low[None, i : i + 1024]
        part += _B
        np.minimum(out, part.min(1), out=out)
    return out


def digest(found: np.ndarray) -> bytes | None:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for i in range(0, len(batch), 512):
            part = batch.iloc[i : i + 512]
            sets = shingle_sets(part["text"])
            signatures = np.stack([signature(s) if len(s) else np.zeros(K, np.uint32) for s in sets]).astype(np.uint64)
            bands = mix((signatures.reshape(-1, BANDS, BAND_ROWS) * _BAND).sum(2)).astype(np.int64)
            yield pd.DataFrame({"key": part["key"], "hash": part["hash"], "digest": [digest(s) for s in sets], "n": [len(s) for s in sets], "bands": list(bands)})


def _collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last = None
    for batch in batches:
        for i in range(0, len(batch), 512):
            part = batch.iloc[i : i + 512]
            before = [last, *part["digest"].iloc[:-1]]  # rows repeated in the input follow one another
            part, last = part[[a != b for a, b in zip(before, part["digest"])]], part["digest"].iloc[-1]
            if not len(part):
                continue
            sets = shingle_sets(part["text"])
            yield part[["digest", "copies", "part", "block", "blocks"]].assign(
                signature=[signature(s).tobytes() for s in sets], shingles=[s.tobytes() for s in sets]
            )


def compare(digests: list[bytes], copies: np.ndarray, blocks: np.ndarray, across: bool, signatures: np.ndarray, sets: list[np.ndarray], threshold: float) -> Iterator[tuple]:
    """Links of a pair of blocks: (class, linked texts, linked documents, the class it is tied to).  across: the blocks are
    two, so that pairs inside either are left to the block's pair with itself."""
    sizes = np.array([len(s) for s in sets], np.int64)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(sizes) - sizes
    mark = np.zeros(int(ids.max()) + 1, bool)
    least = least_matches(threshold, TOLERANCE)
    texts, documents = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
    label = np.arange(len(sets))
    by_size = np.argsort(sizes, kind="stable")
    ordered = sizes[by_size]
    for place, i in enumerate(by_size.tolist()):
        upto = np.searchsorted(ordered, sizes[i] / threshold + 1e-9, "right")
        other = by_size[place + 1 : upto]
        if across:
            other = other[blocks[other] != blocks[i]]
        matches = np.zeros(len(other), np.int64)
        for c in range(0, K - STEP + 1, STEP):
            if not len(other):
                break
            matches = matches + (signatures[other, c : c + STEP] == signatures[i, c : c + STEP]).sum(1)
            alive = matches >= least[c + STEP]
            other, matches = other[alive], matches[alive]
        if not len(other):
            continue
        own = ids[begin[i] : begin[i] + sizes[i]]
        mark[own] = True
        common = np.add.reduceat(mark[ids[ranges(begin[other], sizes[other])]].astype(np.int64), np.cumsum(sizes[other]) - sizes[other])
        mark[own] = False
        other = other[common >= threshold * (sizes[i] + sizes[other] - common) - 1e-9]
        if len(other):
            texts[i] += len(other)
            documents[i] += copies[other].sum()
            texts[other] += 1
            documents[other] += copies[i]
            roots = np.unique(label[np.append(other, i)])
            if len(roots) > 1:
                label[np.isin(label, roots)] = roots[0]
    for i in np.flatnonzero(texts).tolist():
        yield digests[i], int(texts[i]), int(documents[i]), digests[label[i]]


def _verify(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        group = None

        def close() -> pd.DataFrame:
            seen = {d: i for i, d in reversed(list(enumerate(held["digest"])))}  # rows repeated in the input
            at = sorted(seen.values())
            take = lambda c: [held[c][i] for i in at]
            signatures = np.stack([np.frombuffer(s, np.uint32) for s in take("signature")])
            sets = [np.frombuffer(s, np.uint64) for s in take("shingles")]
            found = compare(take("digest"), np.array(take("copies")), np.array(take("block")), group[1] != group[2], signatures, sets, threshold)
            return pd.DataFrame(list(found), columns=["digest", "texts", "documents", "tied"])

        for batch in batches:
            columns = {c: batch[c].tolist() for c in ("digest", "copies", "block", "signature", "shingles")}
            for i, key in enumerate(zip(batch["part"], batch["one"].tolist(), batch["two"].tolist())):
                if key != group:
                    if held:
                        yield close()
                    held, group = {c: [] for c in columns}, key
                for c in columns:
                    held[c].append(columns[c][i])
        if held:
            yield close()

    return run


LOWEST = -(1 << 63)  # stands for a null key


def row_key(key: str) -> Column:
    return F.coalesce(F.col(key).cast("long"), F.lit(LOWEST))


def row_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def link(docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, class_id, n_links, copies, n_texts, text_hash and group_digest, for each row of docs.

    Two rows are linked if the sets of runs of five words (lower case) have a Jaccard similarity of threshold at least.
    class_id is the least key among the rows that links connect, n_links the number of rows linked to this one (copies
    included), copies the rows with the same set (itself included), n_texts the number of different sets linked to its
    own; group_digest is the same in all rows that links connect, null in rows without links.  Null and empty texts are linked to nothing and are a class of their own; a text under five words has one run;
    repeated rows are copies; rows with a null key have the least key; an empty table gives no rows; other columns are
    ignored.  Keys must be integers.
    """
    rows = docs.select(row_key(key).alias("key"), row_hash(text).alias("hash"), F.col(text).alias("text"))
    sketches = cut(rows.mapInPandas(lean(_sketch), "key long, hash long, digest binary, n int, bands array<long>"), "sketches")
    classes = cut(
        sketches.filter("n > 0").groupBy("digest").agg(F.min(F.struct("key", "hash")).alias("rep"), F.count("*").alias("copies"), F.max("n").alias("n"), F.any_value("bands").alias("bands")),
        "classes",
    )
    buckets = classes.select("digest", F.posexplode("bands").alias("band", "value"))
    hubs = buckets.groupBy("band", "value").agg(F.min("digest").alias("hub"), F.max("digest").alias("top")).filter("hub < top").drop("top")
    ties = buckets.join(hubs, ["band", "value"]).filter("digest > hub").select(F.col("digest").alias("a"), F.col("hub").alias("b"))
    parts = components(ties).select(F.col("node").alias("digest"), F.col("root").alias("part"))
    members = cut(classes.drop("bands").join(parts, "digest"), "members")
    count = members.groupBy("part").agg(F.ceil(F.greatest(F.count("*") / BLOCK_CLASSES, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = members.join(count, "part").withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    # both joins with texts are hinted, so that their plan is the same at every size
    wanted = members.select("rep.*", "digest", "copies", "part", "block", "blocks").hint("merge")
    wanted = rows.join(wanted, ["key", "hash"]).select("digest", "copies", "part", "block", "blocks", "text")
    sets = wanted.mapInPandas(lean(_collect), "digest binary, copies long, part binary, block int, blocks int, signature binary, shingles binary")
    pairs = sets.withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "digest", "copies", "part", "block", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two"), "signature", "shingles"
    )
    dealt = pairs.repartition("part", "one", "two").sortWithinPartitions("part", "one", "two")
    found = cut(dealt.mapInPandas(lean(_verify(threshold)), "digest binary, texts long, documents long, tied binary"), "links")
    groups = components(found.select(F.col("digest").alias("a"), F.col("tied").alias("b"))).withColumnRenamed("node", "digest")
    classes = classes.select("digest", F.col("rep.key").alias("rep"), "copies")
    named = classes.select("digest", "rep").join(groups, "digest")
    named = named.join(named.groupBy("root").agg(F.min("rep").alias("least")), "root").select("digest", "least", "root")
    totals = found.groupBy("digest").agg(F.sum("texts").alias("texts"), F.sum("documents").alias("documents"))
    told = classes.filter("copies > 1").select("digest").unionByName(named.select("digest")).distinct()
    told = told.join(classes.select("digest", "rep", "copies"), "digest").join(named, "digest", "left").join(totals, "digest", "left")
    told = cut(told.select("digest", F.coalesce("least", "rep").alias("least"), F.coalesce("root", "digest").alias("root"), "copies", "texts", "documents"), "told")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return join_uneven(sketches.select("key", "hash", "digest"), told, ["digest"], "copies", "left").select(
        F.nullif("key", F.lit(LOWEST)).alias(key),
        F.nullif(F.coalesce("least", "key"), F.lit(LOWEST)).alias("class_id"),
        (zero("documents") + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
        zero("texts").alias("n_texts"),
        F.col("hash").alias("text_hash"),
        F.hex("root").alias("group_digest"),
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of linked rows: the one with the least key (null first), then text hash.

    Rows without links stay as they are.  Of rows repeated with key and text one stays.  Only keys of rows that go are
    joined with docs; no group comes together in a task.
    """
    linked = cut(link(docs, threshold, key, text).filter("group_digest is not null").select(row_key(key).alias("__key"), F.col("text_hash").alias("__hash"), "group_digest"), "linked")
    counted = linked.groupBy("group_digest", "__key", "__hash").agg(F.count("*").alias("n"))
    keeper = counted.groupBy("group_digest").agg(F.min(F.struct("__key", "__hash")).alias("first"))
    judged = cut(counted.join(keeper, "group_digest").withColumn("keep", F.struct("__key", "__hash") == F.col("first")).drop("first"), "judged")
    keyed = docs.withColumn("__key", row_key(key)).withColumn("__hash", row_hash(text))
    rest = keyed.join(judged.filter("not keep or n > 1").select("__key", "__hash").hint("merge"), ["__key", "__hash"], "left_anti")
    rest = rest.select(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = judged.filter("keep and n > 1").select("__key", "__hash")
    if repeated.isEmpty():  # no row is there twice, so the texts need not be shuffled for it
        return rest
    again = keyed.join(repeated, ["__key", "__hash"]).groupBy("__key", "__hash").agg(F.any_value(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row")).select("row.*")
    return rest.unionByName(again)
