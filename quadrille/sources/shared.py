"""Tables in the folder that all executors see, for results that are used more than once."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder, which only a local master can share with its tasks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "quadrille-shared")
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends, lost executors lose nothing.  The
    table goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def by_merge(df: DataFrame) -> DataFrame:
    """df, which joins by sorting both sides: for pixels, runs and cells.  Their files compress so well, and what explodes them
    counts so little in Spark's estimates, that hundreds of megabytes look small enough for a broadcast through the driver."""
    return df.hint("merge")


#: Rows of a part whose number grows with the table.
PART_ROWS = 200_000


def _parts(rows: DataFrame) -> int:
    return -(-rows.count() // PART_ROWS)


def by_image(pixels: DataFrame, *others: DataFrame):
    """pixels with each image in one of spark.sql.shuffle.partitions parts, however small these look, or of as many as the pixels
    fill: windows over rows and over columns then follow each other without a shuffle, Spark does not merge the well compressed
    parts into a few large tasks, and what a task sorts doesn't grow with the table.  Pixels are counted, so they should be a
    projection of a table or written.  Other relations of images come to the same parts, and join by image_id without a shuffle."""
    parts = max(int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions")), _parts(pixels))
    dealt = [df.repartition(parts, "image_id") for df in (pixels, *others)]
    return dealt if others else dealt[0]


def in_parts(df: DataFrame, key: str, like: DataFrame | None = None) -> DataFrame:
    """df with the rows of a key in one of as many parts as the rows of df, or of a table like it, fill; the one that is counted is a
    table as it is read, which tells its rows.  What a task sorts then doesn't grow with the table, whatever number of parts is set; less
    than a part for each core stays as it is."""
    parts = _parts(df if like is None else like)
    return df.repartition(parts, key) if parts > df.sparkSession.sparkContext.defaultParallelism else df


def cut(df: DataFrame, name: str) -> DataFrame:
    """written(), joined by_merge()."""
    return by_merge(written(df, name))


def finished(spark: SparkSession, path: str) -> list[int]:
    """Numbers, in order, of the numbered tables in a folder whose writing came to its end; none where there is no folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    names = [s.getPath() for s in files.listStatus(place)]
    return sorted(int(n.getName()) for n in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(n, "_SUCCESS")))
