"""LM scoring with an n-gram trie in Elias-Fano form.

The corpus is dealt into batches of documents.  A batch counts its words and word pairs, and sends what it has of a context
(the first word) to the context's shard: the counts of its training texts, which are at the same time the queries of all its
texts.  A shard adds up the counts of all batches, builds its part of the trie, maps it from a file and answers each batch
in the batch's order.  So each distinct pair of a batch travels once to its shard and one byte of it back.

Trie: the words of a shard in hash order; monotone pointers to the ranges of their successors; the successors, each range in
order and raised by where the range before ends, so that the whole level is monotone; for each successor a quantised
discounted probability and for each word a quantised weight of what the discount frees.  A pair is found by a successor
search relative to its context's range.
"""

import os
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, mix, offsets, utf8, words

BEGIN, END = mix(np.array([101, 102], np.uint64))
#: Held out are the rows whose crc32 of the key, as text, leaves REST on division by PARTS.
PARTS, REST = 7, 2
DISCOUNT = 0.75
BINS = 255  # of quantised values; the code after the last stands for none
TAIL = np.uint64(0xFFFFFFFF)  # bits of a successor's hash that are kept


class EliasFano:
    """A monotone sequence below `universe`: the low bits packed, the high bits in unary, and counts of them every 64 bits."""

    def __init__(self, arrays: dict[str, np.ndarray], n: int, low_bits: int):
        self.low, self.high, self.ones = arrays["low"], arrays["high"], arrays["ones"]
        self.n, self.low_bits = n, low_bits

    @staticmethod
    def parts(values: np.ndarray) -> tuple[dict[str, np.ndarray], int, int]:
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        high = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(high[-1]) // 64 + 2) * 64 if n else 64, np.uint8)
        bits[high] = 1
        words_ = np.packbits(bits, bitorder="little").view("<u8")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words_))]).astype(np.int64)
        low = np.zeros(n * low_bits // 64 + 2, np.uint64)
        if low_bits:
            part = values & np.uint64((1 << low_bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(low_bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(low_bits) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        return {"low": low, "high": words_, "ones": ones}, n, low_bits

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        value = self.low[word] >> shift
        spill = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (value | spill) & np.uint64((1 << self.low_bits) - 1)

    @staticmethod
    def _in_word(word: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """Place of the nth (from 0) one bit of each word, by halving."""
        place, nth, word = np.zeros(len(word), np.int64), nth.copy(), word.copy()
        for half in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(word & np.uint64((1 << half) - 1)).astype(np.int64)
            up = nth >= low
            nth -= np.where(up, low, 0)
            place += np.where(up, half, 0)
            word = np.where(up, word >> np.uint64(half), word)
        return place

    def get(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, "right") - 1
        place = word * 64 + self._in_word(self.high[word], i - self.ones[word])
        return (place - i).astype(np.uint64) << np.uint64(self.low_bits) | self.lows(i)

    def zeros_before(self, h: np.ndarray) -> np.ndarray:
        """How many values have high bits below h: the ones before the h-th zero (all, beyond the last)."""
        zeros = np.arange(len(self.ones)) * 64 - self.ones
        beyond = h > zeros[-1]
        nth = np.clip(h - 1, 0, max(int(zeros[-1]) - 1, 0))
        word = np.minimum(np.searchsorted(zeros, nth, "right") - 1, len(self.high) - 1)
        place = word * 64 + self._in_word(~self.high[word], nth - zeros[word])
        return np.where(h <= 0, 0, np.where(beyond, self.n, np.minimum(place - nth, self.n)))

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value that is not below x."""
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        at, end = self.zeros_before(high), self.zeros_before(high + 1)
        low = x & np.uint64((1 << self.low_bits) - 1)
        while len(going := np.flatnonzero(at < end)):  # halving, as one high part can hold many values
            middle = (at[going] + end[going]) >> 1
            below = self.lows(middle) < low[going]
            at[going[below]] = middle[below] + 1
            end[going[~below]] = middle[~below]
        return at


def quantise(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of positive values in BINS bins, evenly wide by logarithm, and the bins' means."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(BINS + 1, np.float32)
    logs = np.log(values)
    low, wide = logs.min(), max(float(np.ptp(logs)), 1e-9)
    codes = np.minimum((logs - low) / wide * BINS, BINS - 1).astype(np.uint8)
    count = np.bincount(codes, minlength=BINS + 1)
    book = np.bincount(codes, values, BINS + 1) / np.maximum(count, 1)
    return codes, book.astype(np.float32)


class Trie:
    """A shard's levels, in one file that is mapped into memory."""

    def __init__(self, path: str, layout: dict):
        load = lambda k: np.memmap(path, layout[k][1], "r", layout[k][0], (layout[k][2],)) if layout[k][2] else np.zeros(0, layout[k][1])
        fano = lambda k: EliasFano({p: load(f"{k}.{p}") for p in ("low", "high", "ones")}, *layout[k])
        self.words, self.pointers, self.successors = fano("words"), fano("pointers"), fano("successors")
        self.codes, self.book = load("codes"), load("book")
        self.freed, self.freed_book, self.counts = load("freed"), load("freed_book"), load("counts")

    @staticmethod
    def write(path: str, word: np.ndarray, counts: np.ndarray, context: np.ndarray, tail: np.ndarray, pair_counts: np.ndarray) -> dict:
        """word: sorted; counts: of each as a token; context, tail: of each pair, sorted; pair_counts: over 0."""
        n = np.bincount(context, minlength=len(word))
        total = np.bincount(context, pair_counts, len(word))
        pointers = offsets(n).astype(np.uint64)
        # each range is raised by the last value of the range before, plus one
        last = np.zeros(len(word), np.uint64)
        some = np.flatnonzero(n)
        last[some] = tail[pointers[some + 1].astype(np.int64) - 1].astype(np.uint64) + np.uint64(1)
        base = np.concatenate([[np.uint64(0)], np.cumsum(last)])[:-1].astype(np.uint64)
        codes, book = quantise((pair_counts - DISCOUNT) / total[context])
        freed, freed_book = quantise(DISCOUNT * n[some] / total[some])
        freed_of = np.full(len(word), BINS, np.uint8)
        freed_of[some] = freed
        layout: dict = {}
        with open(path, "wb") as f:

            def put(name: str, values: np.ndarray) -> None:
                f.write(bytes(-f.tell() % 8))
                layout[name] = (f.tell(), values.dtype.str, len(values))
                f.write(values.tobytes())

            for name, values in (("words", word), ("pointers", pointers), ("successors", base[context] + tail.astype(np.uint64))):
                arrays, length, low_bits = EliasFano.parts(values)
                layout[name] = (length, low_bits)
                for part, x in arrays.items():
                    put(f"{name}.{part}", x)
            for name, values in (("codes", codes), ("book", book), ("freed", freed_of), ("freed_book", freed_book), ("counts", counts.astype(np.int64))):
                put(name, values)
        return layout

    def contexts(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each word, and its range of successors' base; every word asked for is there."""
        at = self.words.successor(word)
        return at, self.pointers.get(at).astype(np.int64)

    def pairs(self, context: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """Code of each pair's probability, BINS where there is none: a search for the successor in the context's range."""
        if not self.successors.n:
            return np.full(len(context), BINS, np.uint8)
        kinds, inverse = np.unique(context, return_inverse=True)
        first, stop = self.pointers.get(kinds).astype(np.int64), self.pointers.get(kinds + 1).astype(np.int64)
        base = np.where(first > 0, self.successors.get(np.maximum(first - 1, 0)) + np.uint64(1), np.uint64(0))
        sought = base[inverse] + tail.astype(np.uint64)
        at = self.successors.successor(sought)
        found = (at >= first[inverse]) & (at < stop[inverse])
        where = np.flatnonzero(found)
        found[where] = self.successors.get(at[where]) == sought[where]
        return np.where(found, self.codes[np.minimum(at, self.successors.n - 1)], np.uint8(BINS))


def tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens, words and then END, and how many each text has."""
    hashes, counts = words(utf8(texts))
    out = np.full(len(hashes) + len(counts), END, np.uint64)
    word = np.ones(len(out), bool)
    word[np.cumsum(counts + 1) - 1] = False
    out[word] = hashes
    return out, counts + 1


class Batch:
    """Distinct words of a batch by (shard, hash), its distinct pairs by (first word, successor), and where tokens are."""

    def __init__(self, texts, shards: int):
        self.token, self.counts = tokens(texts)
        before = np.concatenate([[BEGIN], self.token[:-1]]).astype(np.uint64)
        before[offsets(self.counts)[:-1]] = BEGIN
        kinds, at = np.unique(np.concatenate([self.token, [BEGIN]]).astype(np.uint64), return_inverse=True)
        shard = (kinds % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((kinds, shard))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.words, self.shard = kinds[order], shard[order]
        self.at = rank[at[:-1]]  # word of each token
        self.first = np.concatenate([[0], self.at[:-1]])  # word before each token
        self.first[offsets(self.counts)[:-1]] = rank[at[-1]]
        keys = self.first.astype(np.uint64) << np.uint64(32) | self.token & TAIL
        self.pairs, self.pair_at = np.unique(keys, return_inverse=True)


def _ask(shards: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        b = Batch(group["text"], shards)
        times = np.repeat(np.where(group["held"], 0, group["times"]), b.counts)  # rows that a training token stands for
        word_counts = np.bincount(b.at, times, len(b.words)).astype(np.uint32)
        pair_counts = np.bincount(b.pair_at, times, len(b.pairs)).astype(np.uint32)
        first = (b.pairs >> np.uint64(32)).astype(np.int64)
        successors = np.bincount(first, minlength=len(b.words)).astype(np.uint32)
        tails = (b.pairs & TAIL).astype(np.uint32)
        held = np.unique(b.shard)
        w = np.searchsorted(b.shard, np.append(held, shards))
        p = np.searchsorted(first, np.append(w[:-1], len(b.words)))
        cutting = lambda x, c: [x[c[k] : c[k + 1]].tobytes() for k in range(len(held))]
        return pd.DataFrame({
            "shard": held.astype(np.int32), "batch": np.full(len(held), group["batch"].iloc[0], np.int32),
            "words": cutting(b.words, w), "word_counts": cutting(word_counts, w), "successors": cutting(successors, w),
            "tails": cutting(tails, p), "pair_counts": cutting(pair_counts, p),
        })

    return run


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("batch")
    load = lambda c, kind: [np.frombuffer(x, kind) for x in group[c]]
    asked, successors, tails = load("words", np.uint64), load("successors", np.uint32), load("tails", np.uint32)
    every, inverse = np.unique(np.concatenate(asked), return_inverse=True)
    counts = np.bincount(inverse, np.concatenate(load("word_counts", np.uint32)), len(every)).astype(np.int64)
    context = np.repeat(inverse, np.concatenate(successors))
    pair_counts = np.concatenate(load("pair_counts", np.uint32))
    seen = pair_counts > 0
    keys, at = np.unique(context[seen].astype(np.uint64) << np.uint64(32) | np.concatenate(tails)[seen].astype(np.uint64), return_inverse=True)
    pair_counts = np.bincount(at, pair_counts[seen], len(keys))
    file, path = tempfile.mkstemp(suffix=".trie")
    os.close(file)
    try:
        trie = Trie(path, Trie.write(path, every, counts, (keys >> np.uint64(32)).astype(np.int64), (keys & TAIL).astype(np.uint32), pair_counts))
        out = []
        for batch, w, n, t in zip(group["batch"], asked, successors, tails):
            index, _ = trie.contexts(w)
            out.append((batch, trie.counts[index].tobytes(), trie.freed[index].tobytes(), trie.pairs(np.repeat(index, n), t).tobytes()))
        book, freed_book = trie.book.tobytes(), trie.freed_book.tobytes()
    finally:
        os.unlink(path)
    shard = int(group["shard"].iloc[0])
    made = pd.DataFrame(out, columns=["batch", "counts", "freed", "codes"]).assign(shard=shard, book=book, freed_book=freed_book, n_tokens=0, n_kinds=0)
    made.loc[0, ["n_tokens", "n_kinds"]] = [int(counts.sum()), int((counts > 0).sum())]
    return made[["shard", "batch", "counts", "freed", "codes", "book", "freed_book", "n_tokens", "n_kinds"]]


def _score(shards: int, total: int, kinds: int):
    def run(group: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return pd.DataFrame(columns=["key", "held_out", "n_tokens", "n_known", "base_score", "score", "times"])
        b = Batch(group["text"], shards)
        answers = answers.sort_values("shard")
        values = lambda c, book: np.concatenate([np.append(np.frombuffer(y, np.float32)[:BINS], none)[np.frombuffer(x, np.uint8)] for x, y in zip(answers[c], answers[book])])
        none = 0.0
        pair = values("codes", "book")[b.pair_at]
        none = 1.0
        freed = values("freed", "freed_book")[b.first]
        count = np.concatenate([np.frombuffer(x, np.int64) for x in answers["counts"]])[b.at]
        base = (count + 1) / (total + kinds + 1)
        first = offsets(b.counts)[:-1]
        add = lambda x: np.add.reduceat(x, first)
        return pd.DataFrame({
            "key": group["key"], "held_out": group["held"], "n_tokens": b.counts, "n_known": add((count > 0).astype(np.int64)),
            "base_score": add(np.log10(base)), "score": add(np.log10(pair + freed * base)), "times": group["times"],
        })

    return run


def once(rows: DataFrame) -> DataFrame:
    """rows(key, text, ...) with each repeated row once, and as times how often it is there.  Only keys and hashes are shuffled
    to find them; where no row is repeated, no text is."""
    rows = rows.withColumn("hash", F.xxhash64("text"))
    again = cut(rows.groupBy("key", "hash").agg(F.count("*").alias("times")).filter("times > 1"), "repeated")
    if again.isEmpty():
        return rows.drop("hash").withColumn("times", F.lit(1).cast("long"))
    same = rows["key"].eqNullSafe(again["key"]) & (rows["hash"] == again["hash"])
    single = rows.join(again, same, "left_anti").withColumn("times", F.lit(1).cast("long"))
    merged = rows.join(again, same).groupBy(rows["key"], rows["hash"], "times").agg(*[F.any_value(c).alias(c) for c in rows.columns if c not in ("key", "hash")])
    return single.unionByName(merged).drop("hash")


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    Tokens are words in lower case (A-Z), then one end; the model learns pairs of tokens of all rows that are not held out,
    a text's first token following a begin mark.  A pair's probability is its discounted share of its context's pairs, plus
    what the discount frees times the add-one probability of the token, which is what base_score sums.  score is the model's
    log10 probability of the text.  A null text is empty and has one token; rows with a null key are never held out;
    repeated rows are worked out once, count as often as they are there and stay; an empty table gives no rows; other columns are ignored.  Successors are told apart by 32
    bits of their hash within a context, words by 64.
    """
    spark = docs.sparkSession
    shards = max(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    held = F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(PARTS)) == REST, F.lit(False))
    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), held.alias("held"))
    rows = once(rows).withColumn("batch", F.pmod(F.xxhash64("key", "text"), F.lit(shards)).cast("int"))
    asked = rows.groupBy("batch").applyInPandas(_ask(shards), "shard int, batch int, words binary, word_counts binary, successors binary, tails binary, pair_counts binary")
    answers = asked.groupBy("shard").applyInPandas(_answer, "shard int, batch int, counts binary, freed binary, codes binary, book binary, freed_book binary, n_tokens long, n_kinds long")
    answers = cut(answers, "lm-answers")
    total, kinds = answers.agg(F.sum("n_tokens"), F.sum("n_kinds")).first()
    schema = "key string, held_out boolean, n_tokens long, n_known long, base_score double, score double, times long"
    scored = rows.groupBy("batch").cogroup(answers.drop("n_tokens", "n_kinds").groupBy("batch")).applyInPandas(_score(shards, total or 0, kinds or 0), schema)
    scored = scored.withColumn("one", F.explode(F.sequence(F.lit(1), F.col("times"))))  # repeated rows are rows again
    return scored.select(F.col("key").cast(docs.schema[key].dataType).alias(key), "held_out", "n_tokens", "n_known", F.lit(total or 0).cast("long").alias("train_tokens"), "base_score", "score")
