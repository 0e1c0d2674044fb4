"""Product codes of vectors by integer Lloyd rounds, each of which moves only what changed.

Vectors are stored once, in buckets of a row number.  A round reads them beside the previous codes, which lie in the same
buckets, so no vector is shuffled; it writes the new codes and, from each task, what parts that changed their entry take
from one sum and add to another.  Only those few numbers are shuffled, and added to the written sums.
"""

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import cut, join_uneven, shared_dir

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integers beyond this are held at it, so that squared distances of up to 16 components fit 64 bits.
MOST = 1 << 28
#: Below this a product of up to 256 components is exact in doubles.
EXACT = 1 << 21
_ADDED = "row long, code binary, part int, entry int, pos int, value long"


def _buckets(df: DataFrame, n: int, name: str) -> tuple[DataFrame, str, str]:
    """df written in n buckets of row, and the table's name and path.  The files go when the application ends."""
    spark, table = df.sparkSession, f"quadrille_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    df.write.bucketBy(n, "row").option("path", path).option("compression", "zstd").saveAsTable(table, format="parquet")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.table(table), table, path


def _remove(spark: SparkSession, table: str, path: str) -> None:
    spark.sql(f"DROP TABLE {table}")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def integers(vectors: DataFrame, key: str, vector: str, label: str, parts: int, scale: int) -> DataFrame:
    """row, key, label, ints of the vectors that have only finite components and a length that parts divides."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN counts as larger than infinity
    whole = F.transform(v, lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(x * scale))).cast("int"))
    kept = vectors.filter(v.isNotNull() & finite & (F.size(v) > 0) & (F.size(v) % parts == 0))
    return kept.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(label).alias("label"), whole.alias("ints"))


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector and part the nearest entry, the lower one of ties, and its squared distance.  x: (rows, components)."""
    parts, _, width = books.shape
    codes, far = np.zeros((len(x), parts), np.uint8), np.zeros((len(x), parts), np.int64)
    small = width <= 256 and max(np.abs(x).max(initial=0), np.abs(books).max(initial=0)) < EXACT
    for p in range(parts):
        own, book = x[:, p * width : (p + 1) * width], books[p]
        if small:
            own, book = own.astype(np.float64), book.astype(np.float64)
            d = (own * own).sum(1)[:, None] - 2 * (own @ book.T) + (book * book).sum(1)
        else:
            d = np.stack([np.square(own - entry).sum(1) for entry in book], 1)
        codes[:, p] = d.argmin(1)
        far[:, p] = d.min(1)
    return codes, far


def _matrix(ints: pa.Array, dims: int) -> np.ndarray:
    return ints.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _binary(codes: np.ndarray) -> pa.Array:
    n, width = codes.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(codes))])


def _move(books: np.ndarray, dims: int):
    """Task of a round: rows with their new codes, then (part, entry, pos, value) to be added; pos is -1 for the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.shape
        change, last = np.zeros((parts, entries, width + 1), np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch["ints"], dims)
            codes, _ = nearest(x, books)
            fresh = "code" not in batch.schema.names
            before = None if fresh else np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(codes.shape)
            for p in range(parts):
                moved = slice(None) if fresh else np.flatnonzero(codes[:, p] != before[:, p])
                values = np.column_stack([np.ones(len(x), np.int64), x[:, p * width : (p + 1) * width]])[moved]
                for sign, at in ((1, codes[moved, p]), *([] if fresh else [(-1, before[moved, p])])):
                    for j in range(width + 1):  # sums of a batch are exact in doubles
                        change[p, :, j] += sign * np.bincount(at, values[:, j], entries).astype(np.int64)
            last = batch["row"][batch.num_rows - 1].as_py()
            none = [pa.nulls(batch.num_rows, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch["row"], _binary(codes), *none], ["row", "code", "part", "entry", "pos", "value"])
        p, e, j = np.nonzero(change)
        if len(p):  # they carry a row of this task, so they stay in its bucket
            at = [pa.array(i.astype(np.int32)) for i in (p, e, j - 1)]
            yield pa.RecordBatch.from_arrays([pa.array([last] * len(p), pa.int64()), pa.nulls(len(p), pa.binary()), *at, pa.array(change[p, e, j])], ["row", "code", "part", "entry", "pos", "value"])

    return run


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[list[list[int]]]]:
    """(rows, codebooks): key, label, code (two hex digits for each part) and error (squared distance) of each vector that is
    kept, and codebooks[part][entry], the integer components.

    Components become floor(scale * x).  Codebooks start as the parts of the vectors with the least keys (null last; rows with
    equal keys by their components); with fewer vectors than entries there are fewer entries.  A round assigns each part to
    its nearest entry, the lower of ties, and each entry becomes the floor of its parts' mean; unused entries stay.  A vector
    is dropped if it is null or empty, holds null or non-finite components, if parts does not divide its length, or if its
    length is not that of the vector with the least key.  Integers are held at 2**28 in size.  Repeated rows count as often as
    they are there; an empty table gives no rows and no codebooks; other columns are ignored, whatever their names.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's index must fit one byte")
    spark = vectors.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    every, _, _ = _buckets(integers(vectors, key, vector, label, parts, scale).repartition(n, "row"), n, "vectors")
    order = [F.col("key").asc_nulls_last(), "ints"]
    least = every.orderBy(*order).select("ints").first()
    dims = len(least["ints"]) if least else parts
    store = every.filter(F.size("ints") == dims)
    start = store.orderBy(*order).select("ints").limit(entries).collect()
    books = np.array([r["ints"] for r in start], np.int64).reshape(len(start), parts, dims // parts).swapaxes(0, 1).copy()

    old = sums = None
    for _ in range(rounds if start else 0):
        both = store.select("row", "ints")
        if old:
            both = both.join(old[0].filter("part IS NULL").select("row", "code").hint("shuffle_hash"), "row")
        new = _buckets(both.mapInArrow(_move(books, dims), _ADDED), n, "codes")
        added = new[0].filter("part IS NOT NULL").select("part", "entry", "pos", "value")
        sums = cut((sums.unionByName(added) if sums else added).groupBy("part", "entry", "pos").agg(F.sum("value").alias("value")), "code-sums")
        if old:
            _remove(spark, *old[1:])
        old = new
        total = np.zeros((parts, len(start), dims // parts + 1), np.int64)
        for r in sums.collect():  # parts x entries x (width + 1) rows at most
            total[r["part"], r["entry"], r["pos"] + 1] = r["value"]
        held = total[:, :, :1]
        moved = np.where(held > 0, total[:, :, 1:] // np.maximum(held, 1), books)
        if (moved == books).all():
            break  # all rounds that are left would do the same
        books = moved

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, far = nearest(_matrix(batch["ints"], dims), books)
            yield pa.RecordBatch.from_arrays([batch["key"], batch["label"], _binary(codes), pa.array(far.sum(1))], ["key", "label", "code", "error"])

    rows = store.select("key", "label", "ints")
    coded = rows.mapInArrow(final, rows.select("key", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")).schema)
    return coded.select(F.col("key").alias(key), F.col("label").alias(label), F.lower(F.hex("code")).alias("code"), "error"), books.tolist()


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """coded with label_error, the sum of error over the rows with an equal label; null is a label of its own."""
    named = cut(coded.withColumn("__label", F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("null"))), "code-rows")
    found = cut(named.groupBy("__label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("__n")), "code-labels")
    return join_uneven(named, found, ["__label"], "__n").drop("__label", "__n")


def books_digest(books: list[list[list[int]]]) -> str:
    """Digest (hex text) of all components, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for part in books for entry in part for x in entry).encode()).hexdigest()
