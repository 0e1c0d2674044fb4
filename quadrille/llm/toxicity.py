"""Toxicity: subword-bag embeddings, averaged over a few words, into a linear softmax; both trained jointly in numpy.

A word is the bag of the character n-grams of its lower-case form between spaces, so misspelt words share most vectors with
the words they are taken for.  A text scores as its worst run of RUN words, so that long texts do not drown a few words.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import chunks, lean, offsets, prefix_hash, ranges, release, span_hash

GRAMS = (3, 4, 5)  # bytes
BUCKETS, DIMENSIONS = 1 << 17, 8
RUN = 6  # words whose vectors are averaged
REJECT = 0.7
#: The sample that a model is fitted on: rows of each label at most, and characters of a row at most.
TRAIN_ROWS, TRAIN_CHARS = {1: 2000, 0: 5000}, 6_000
EPOCHS, WHOLE_EPOCHS, RATE, DECAY, DROP = 110, 30, 0.05, 1e-4, 0.3

#: Bytes of words: letters, digits and all beyond ASCII; the others separate words.
_TABLE = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def spaced(text: str | None) -> bytes:
    """A text as lower-case UTF-8 words between spaces."""
    return b"" if text is None else text.lower().encode("utf-8", "surrogatepass").translate(_TABLE)


def grams(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: the bucket of each n-gram, the word that it belongs to, and the number of words of each text."""
    raw = [spaced(t) for t in texts]
    buckets, owners, counts, seen = [], [], np.zeros(len(raw), np.int64), 0
    for i, j in chunks(raw):
        data = np.frombuffer(b" " + b" ".join(raw[i:j]) + b" ", np.uint8)
        inside = data != 32
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        start, end = edge[::2], edge[1::2]
        prefix = prefix_hash(data)
        for n in GRAMS:
            count = np.maximum(end - start + 3 - n, 0)
            at = ranges(start - 1, count)
            buckets.append((span_hash(prefix, at, at + n) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32))
            owners.append(np.repeat(np.arange(seen, seen + len(start), dtype=np.int32), count))
        stops = np.cumsum([len(t) + 1 for t in raw[i:j]]) + 1
        counts[i:j] = np.diff(np.searchsorted(start, stops), prepend=0)
        seen += len(start)
    join = lambda parts: np.concatenate([*parts, np.zeros(0, np.int32)])
    return join(buckets), join(owners), counts


def run_means(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean of each run of RUN words (or of all, in shorter texts), the first word of each run, and runs of each text."""
    first = offsets(counts)[:-1]
    runs = np.where(counts >= RUN, counts - RUN + 1, np.minimum(counts, 1))
    begin = ranges(first, runs)
    size = np.repeat(np.minimum(counts, RUN), runs)
    total = np.concatenate([[0.0], np.cumsum(values)])
    return (total[begin + size] - total[begin]) / np.maximum(size, 1), begin, runs


def worst(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest run mean of each text (-inf without words) and the run's first word."""
    means, begin, runs = run_means(values, counts)
    out, at = np.full(len(counts), -np.inf), np.zeros(len(counts), np.int64)
    some = np.flatnonzero(runs)
    if len(some):
        first = offsets(runs)[:-1][some]
        out[some] = np.maximum.reduceat(means, first)
        hit = np.flatnonzero(means == np.repeat(out[some], runs[some]))
        text = np.repeat(some, runs[some])[hit]
        text, index = np.unique(text, return_index=True)
        at[text] = begin[hit[index]]
    return out, at


def fit(texts: list[str], labels: list[int], seed: int = 7) -> dict:
    """Train embeddings and softmax together.  At first a text is the mean of all its words; then the worst run of its
    words, as it is when scoring.  Without rows of both labels the model gives every text score 0."""
    y = np.array(labels, float)
    if not 0 < y.sum() < len(y):
        return {"value": np.zeros(BUCKETS, np.float32), "bias": -50.0}
    numbers: dict[bytes, int] = {}
    parts = [[numbers.setdefault(w, len(numbers)) for w in spaced(t).split()] for t in texts]
    counts = np.array([len(p) for p in parts], np.int64)
    kind = np.array([k for p in parts for k in p], np.int32)  # equal words are worked out once
    del parts
    bucket, owner, _ = grams([w.decode(errors="ignore") for w in numbers])
    n_words, n_kinds = len(kind), len(numbers)
    per_kind = np.maximum(np.bincount(owner, minlength=n_kinds), 1).astype(float)
    rng = np.random.default_rng(seed)
    text_of = np.repeat(np.arange(len(y)), counts)
    some = counts > 0
    weight = np.where(y == 1, 0.25 / y.sum(), 0.75 / (len(y) - y.sum())) * some
    vectors = rng.normal(0, 0.3, (BUCKETS, DIMENSIONS)).astype(np.float32)
    softmax = rng.normal(0, 0.3, (DIMENSIONS, 2))
    params = {"vectors": vectors, "softmax": softmax, "bias": np.zeros(2)}
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in params.items()}
    for epoch in range(EPOCHS):
        shown = rng.random(BUCKETS) >= DROP  # n-grams that are left out of this epoch, so that words don't hang on a few
        value = (params["vectors"] @ (params["softmax"][:, 1] - params["softmax"][:, 0])) * shown / (1 - DROP)
        word = (np.bincount(owner, value[bucket], n_kinds) / per_kind)[kind]
        bias = params["bias"][1] - params["bias"][0]
        if epoch < WHOLE_EPOCHS:
            score = np.bincount(text_of, word, len(y)) / np.maximum(counts, 1)
            score *= RUN
        else:
            score, at = worst(word, counts)
            score = np.where(some, score, 0) * RUN
        p = 1 / (1 + np.exp(-np.clip(score + bias, -50, 50)))
        slope = (p - y) * weight
        if epoch < WHOLE_EPOCHS:
            pull = (slope / np.maximum(counts, 1))[text_of] * RUN
        else:
            size = np.minimum(counts, RUN)
            pull = np.bincount(ranges(at, size), np.repeat(slope / np.maximum(size, 1), size) * RUN, n_words)
        pull = np.bincount(kind, pull, n_kinds) / per_kind
        used = np.flatnonzero(pull[owner])
        share = np.bincount(bucket[used], pull[owner[used]], BUCKETS) * shown / (1 - DROP)
        direction = params["softmax"][:, 1] - params["softmax"][:, 0]
        toward = share @ params["vectors"]
        gradients = {
            "vectors": np.outer(share, direction).astype(np.float32) + np.float32(DECAY / len(y)) * params["vectors"],
            "softmax": np.stack([-toward, toward], 1),
            "bias": np.array([-slope.sum(), slope.sum()]),
        }
        for k, g in gradients.items():
            one, two = moments[k]
            one += 0.1 * (g - one)
            two += 0.01 * (g * g - two)
            step = RATE * (one / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(two / (1 - 0.99 ** (epoch + 1))) + 1e-8)
            params[k] -= step.astype(params[k].dtype)
    direction = params["softmax"][:, 1] - params["softmax"][:, 0]
    return {"value": (params["vectors"] @ direction * RUN).astype(np.float32), "bias": float(params["bias"][1] - params["bias"][0])}


def score_texts(model: dict, texts) -> np.ndarray:
    bucket, owner, counts = grams(texts)
    n = int(counts.sum())
    word = np.bincount(owner, model["value"][bucket], n) / np.maximum(np.bincount(owner, minlength=n), 1)
    found, _ = worst(word, counts)
    return np.where(counts > 0, 1 / (1 + np.exp(-np.clip(found + model["bias"], -50, 50))), 0.0)


def held_out(key: str):
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> dict:
    """A model from labelled rows that are not held out: of each label the TRAIN_ROWS keys first by a digest, of which the
    rows over TRAIN_CHARS are left out.  The keys are that few, so they are broadcast, and no text is shuffled."""
    rows = labels.select(F.col(key).alias("key"), F.col(label).alias("label")).filter(~held_out("key")).distinct()
    first = lambda df, *more: df.orderBy(F.md5(F.col("key").cast("string")), *more)
    texts, marks = [], []
    for mark, most in TRAIN_ROWS.items():
        keys = first(rows.filter((F.col("label") == mark) & F.col("key").isNotNull())).limit(most).select("key")
        named = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.length("text") <= TRAIN_CHARS)
        found = first(named.join(F.broadcast(keys), "key"), "text").limit(most).select("text").toPandas()["text"].tolist()
        texts += found
        marks += [mark] * len(found)
    model = fit(texts, marks)
    del texts
    release()
    return model


def score(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs' key with held_out, score and predicted (score from REJECT up).

    A null or empty text, or one without letters and digits, scores 0; equal texts score the same; repeated rows stay; an
    empty table gives no rows; a null key is not held out; other columns are dropped, whatever their names.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.iloc[i : i + 256]
                yield pd.DataFrame({"key": part["key"], "score": score_texts(model, part["text"])})

    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    scored = rows.mapInPandas(run, "key string, score double")
    return scored.select(F.col("key").cast(docs.schema[key].dataType).alias(key), held_out("key").alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs without the rows whose text scores REJECT or more; nothing is joined, so null keys and repeated rows are kept."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield part.filter(pa.array(score_texts(model, part.column(at).to_pylist()) < REJECT))

    return docs.mapInArrow(lean(run), docs.schema)
