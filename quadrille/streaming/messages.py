"""The messages of running jobs, as VARIANT values that are split by their type."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The types of messages, and the fields of each with their kinds.
FIELDS = {
    "job_id": {"data": "string"},
    "progress": {"data": "long"},
    "log": {"data": "string"},
    "done": {"success": "boolean", "message": "string", "download_url": "string"},
}
#: What a message of a type must have.
NEEDED = {"job_id": "data", "progress": "data", "log": "data", "done": "success"}


def parse_messages(raw: DataFrame) -> DataFrame:
    """raw(job_id, seq, body: JSON text) -> job_id, seq, kind, value (VARIANT), body.  kind is the message's type, or invalid
    where the text is no JSON object, has no known type, or lacks what its type must have."""
    value = raw.withColumn("value", F.try_parse_json("body"))
    get = lambda field, kind: F.try_variant_get("value", f"$.{field}", kind)
    tag = get("type", "string")
    kind = F.lit("invalid")
    for name, field in NEEDED.items():
        kind = F.when((tag == name) & get(field, FIELDS[name][field]).isNotNull(), name).otherwise(kind)
    return value.select("job_id", "seq", kind.alias("kind"), "value", "body")


def of_kind(messages: DataFrame, kind: str) -> DataFrame:
    """job_id, seq and the fields of the messages of one type; of invalid ones their text."""
    fields = [F.try_variant_get("value", f"$.{f}", t).alias(f) for f, t in FIELDS.get(kind, {}).items()] or ["body"]
    return messages.filter(F.col("kind") == kind).select("job_id", "seq", *fields)


def write_batch(batch: DataFrame, epoch: int, path: str) -> None:
    """Write a batch's messages, each type into a folder of its own and in it the batch's, which is replaced as a whole: a batch
    that comes again leaves what was there."""
    messages = parse_messages(batch)
    messages.persist()
    try:
        for kind in (*FIELDS, "invalid"):
            of_kind(messages, kind).write.mode("overwrite").parquet(f"{path}/{kind}/batch={epoch}")
    finally:
        messages.unpersist()


def split_messages(stream: DataFrame, path: str, checkpoint: str):
    """Start a query that splits raw messages by type."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, epoch: write_batch(batch, epoch, path)).trigger(availableNow=True).start()


def read_messages(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{kind}").drop("batch")
