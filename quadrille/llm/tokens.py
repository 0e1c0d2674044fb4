"""Token counts: byte-pair merges of many pre-tokens at once, held as ragged numpy arrays."""

import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"  # stands for a space in the vocabulary
#: A pre-token: marks and what follows up to the next mark.  No piece of the vocabulary has a mark after another character.
PRE_TOKEN = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Pre-tokens with more symbols are merged one by one with a heap, as each round of the array form reads all their symbols.
LONG = 256
#: A task keeps the results of so many pre-tokens, then starts afresh.
HELD = 400_000
_LOADED: dict[str, "Merges"] = {}


class Merges:
    """Symbols and ranked merges of a piece vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        crossing = [p for p in self.ids if MARK in p.lstrip(MARK)]
        if crossing:
            raise ValueError(f"pieces that cross pre-tokens: {crossing[:3]}")
        self.n = n
        score = {i: model.get_score(i) for i in plain}
        rank = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = np.zeros(n, np.int64)
        self.rank[plain] = [rank[score[i]] for i in plain]
        pairs = {}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                a, b = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a * n + b] = i
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        # the Bloom-like table keeps most lookups off the binary search
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.spot(self.keys)] = True

    @staticmethod
    def spot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(42)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1.  Symbols outside the vocabulary are negative."""
        out = np.full(len(left), -1, np.int64)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left[at] * self.n + right[at]
        some = self.maybe[self.spot(keys)]
        at, keys = at[some], keys[some]
        found = np.searchsorted(self.keys, keys)
        found[found == len(self.keys)] = 0
        hit = self.keys[found] == keys
        out[at[hit]] = self.made[found[hit]]
        return out

    def by_heap(self, symbols: list[int], cost: list[int]) -> int:
        """Tokens of one long pre-token: merges by rank, then from the left."""
        n = len(symbols)
        symbols, after, before = symbols[:], [*range(1, n), -1], [-1, *range(n - 1)]
        heap = []

        def push(i: int):
            j = after[i] if i >= 0 else -1
            if j >= 0 and symbols[i] >= 0 and symbols[j] >= 0:
                made = self.pairs.get(symbols[i] * self.n + symbols[j])
                if made is not None:
                    heapq.heappush(heap, (int(self.rank[made]), i, j, symbols[i], symbols[j], made))

        for i in range(n):
            push(i)
        total = sum(cost)
        gone = [False] * n
        while heap:
            _, i, j, a, b, made = heapq.heappop(heap)
            if gone[i] or gone[j] or after[i] != j or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i] = made
            gone[j] = True
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            total -= 1
            push(before[i])
            push(i)
        return total

    def count(self, tokens: list[str]) -> np.ndarray:
        """Number of symbols that survive in each pre-token; a character outside the vocabulary counts its UTF-8 bytes."""
        lengths = np.array([len(t) for t in tokens], np.int64)
        chars = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32)
        alphabet, inverse = np.unique(chars, return_inverse=True)
        known = np.array([self.ids.get(chr(c), -1) for c in alphabet.tolist()], np.int64)
        size = np.array([1 if i >= 0 else len(chr(c).encode("utf-8", "surrogatepass")) for c, i in zip(alphabet.tolist(), known.tolist())], np.int64)
        symbols, cost = known[inverse], size[inverse]
        ends = np.cumsum(lengths)
        total = np.zeros(len(tokens), np.int64)
        for t in np.flatnonzero(lengths > LONG):
            at = slice(int(ends[t] - lengths[t]), int(ends[t]))
            total[t] = self.by_heap(symbols[at].tolist(), cost[at].tolist())
        owner = np.repeat(np.arange(len(tokens)), lengths)
        keep = np.repeat(lengths <= LONG, lengths)
        symbols, owner, cost = symbols[keep], owner[keep], cost[keep]
        total += np.bincount(owner, cost, len(tokens)).astype(np.int64)
        none = np.iinfo(np.int64).max
        made = self.pairs_of(symbols, owner)
        while len(symbols):
            rank = np.where(made >= 0, self.rank[made], none)
            first = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1])
            count = np.diff(np.append(first, len(owner)))
            least = np.minimum.reduceat(rank, first)
            # sequences without a merge are finished
            going = np.repeat(least < none, count)
            symbols, owner, made, rank = symbols[going], owner[going], made[going], rank[going]
            if not len(symbols):
                break
            least, count = least[least < none], count[least < none]
            at = np.flatnonzero(rank == np.repeat(least, count))
            # of pairs that overlap every second one goes, from the left
            run = np.concatenate([[True], np.diff(at) != 1])
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[nth % 2 == 0]
            total -= np.bincount(owner[at], minlength=len(tokens))
            symbols[at] = made[at]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            fresh = np.zeros(len(symbols), bool)
            fresh[at] = True
            fresh[at[at > 0] - 1] = True
            # the symbol before a merged pair may itself be the right half of another merged pair
            two = at[(at > 1)]
            fresh[two - 2] = True
            symbols, owner, made, fresh = symbols[stay], owner[stay], made[stay], fresh[stay]
            redo = np.flatnonzero(fresh)
            nxt = np.minimum(redo + 1, len(symbols) - 1)
            found = self.look_up(symbols[redo], symbols[nxt])
            found[(owner[redo] != owner[nxt]) | (redo == nxt)] = -1
            made[redo] = found
        return total

    def pairs_of(self, symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """For each symbol what it makes with the next of its sequence, or -1."""
        made = np.full(len(symbols), -1, np.int64)
        if len(symbols) > 1:
            made[:-1] = self.look_up(symbols[:-1], symbols[1:])
            made[:-1][owner[:-1] != owner[1:]] = -1
        return made


def loaded(path: str) -> Merges:
    if path not in _LOADED:
        _LOADED[path] = Merges(path)
    return _LOADED[path]


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens, over_limit: tokens that the sentencepiece BPE model (a path on every executor) gives each text.

    Spaces become marks and one mark is put before a text that is not empty.  Texts are cut into pre-tokens; those
    not met so far are merged together and each text sums its own.  A null text is empty and has no tokens; rows are
    independent, so ties, repeated rows and an empty table need no care; other columns are dropped, whatever their names.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        merges, held = loaded(model), {}  # held: symbols of pre-tokens that this task has seen
        get = held.__getitem__
        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"]]
            for i in range(0, len(texts), 1024):
                cut = [PRE_TOKEN.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts[i : i + 1024]]
                if len(held) > HELD:
                    held.clear()
                fresh = list(set(itertools.chain.from_iterable(cut)).difference(held))
                if fresh:
                    held.update(zip(fresh, merges.count(fresh).tolist()))
                yield pd.DataFrame({
                    "key": batch["key"].iloc[i : i + 1024],
                    "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts[i : i + 1024]],
                    "n_tokens": [sum(map(get, c)) for c in cut],
                })

    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    counted = rows.mapInPandas(run, "key string, n_bytes long, n_tokens long")
    return counted.select(F.col("key").cast(docs.schema[key].dataType).alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
