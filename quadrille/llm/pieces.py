"""Encoding to and decoding from the ids of a sentencepiece BPE model, by rounds of merges over many words at once."""

import codecs
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import offsets, ranges
from .tokens import MARK, PRE_TOKEN, Merges

#: A task keeps the ids of so many words, then starts afresh.
HELD = 400_000
#: Texts are worked off so many characters at a time; one longer text is a chunk of its own.
CHUNK_CHARS = 1 << 20
_NONE = np.iinfo(np.int64).max
_LOADED: dict[str, "Pieces"] = {}

codecs.register_error("quadrille-each-byte", lambda e: ("�", e.start + 1))


class Pieces(Merges):
    """A piece vocabulary with byte fallback, for texts to ids and back."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__(path)
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(self.n)]
        self.control = np.array([model.is_control(i) for i in range(self.n)])
        self.bytes = {int(p[3:-1], 16): i for i, p in enumerate(names) if model.is_byte(i)}
        if len(self.bytes) < 256:
            raise ValueError("the model has no byte pieces")
        self.unknown = model.unk_id()
        self.raw = [p.replace(MARK, " ").encode() for p in names]
        for b, i in self.bytes.items():
            self.raw[i] = bytes([b])
        for i in np.flatnonzero(self.control).tolist():
            self.raw[i] = b""
        self.raw[self.unknown] = " ⁇ ".encode()
        self.marked = np.array([p.startswith(MARK) for p in names])
        # a merge that makes a hasty piece can open a pair that goes before others of its own rank
        self.hasty = np.zeros(self.n, bool)
        for half in (self.keys // self.n, self.keys % self.n):
            self.hasty[half[self.rank[self.made] <= self.rank[half]]] = True

    def spell(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all characters and the word of each; a character outside the vocabulary is its bytes' pieces."""
        lengths = np.array([len(w) for w in words], np.int64)
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        alphabet, inverse = np.unique(chars, return_inverse=True)
        spelt = [[self.ids[c]] if c in self.ids else [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")] for c in map(chr, alphabet.tolist())]
        size = np.array([len(s) for s in spelt], np.int64)
        flat = np.array([*itertools.chain.from_iterable(spelt)], np.int64)
        symbols = flat[ranges(offsets(size)[:-1][inverse], size[inverse])] if len(flat) else flat
        return symbols, np.repeat(np.repeat(np.arange(len(words)), lengths), size[inverse])

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has.

        Each round finds the least rank in every word, merges the pairs of that rank from the left, and closes the gaps;
        words without a pair leave.  Where a merge would open a pair that is as good or better, later ones of that word wait for the next round.
        """
        symbols, owner = self.spell(words)
        made = self.pairs_of(symbols, owner)
        done_ids, done_owner = [], []
        while len(symbols):
            rank = np.where(made >= 0, self.rank[made], _NONE)
            first = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1])
            count = np.diff(np.append(first, len(owner)))
            least = np.minimum.reduceat(rank, first)
            ended = np.repeat(least == _NONE, count)
            if ended.any():
                done_ids.append(symbols[ended])
                done_owner.append(owner[ended])
                symbols, owner, made, rank = symbols[~ended], owner[~ended], made[~ended], rank[~ended]
                least, count = least[least < _NONE], count[least < _NONE]
            at = np.flatnonzero(rank == np.repeat(least, count))
            if not len(at):
                break
            run = np.concatenate([[True], np.diff(at) != 1])
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = self._in_turn(at[nth % 2 == 0], symbols, owner, made)
            symbols[at] = made[at]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            fresh = np.zeros(len(symbols), bool)
            fresh[at] = True
            fresh[at[at > 0] - 1] = True
            fresh[at[at > 1] - 2] = True  # the symbol before may be the right half of another merged pair
            symbols, owner, made, fresh = symbols[stay], owner[stay], made[stay], fresh[stay]
            redo = np.flatnonzero(fresh)
            after = np.minimum(redo + 1, len(symbols) - 1)
            found = self.look_up(symbols[redo], symbols[after])
            found[(owner[redo] != owner[after]) | (redo == after)] = -1
            made[redo] = found
        if not done_ids:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        return ids[np.argsort(owner, kind="stable")].astype(np.int32), np.bincount(owner, minlength=len(words))

    def _in_turn(self, at: np.ndarray, symbols: np.ndarray, owner: np.ndarray, made: np.ndarray) -> np.ndarray:
        """Of the places at those that merge now: in each word up to the first one that opens a pair as good or better."""
        word, new = owner[at], made[at]
        again = np.concatenate([[False], word[1:] == word[:-1]])
        if not (self.hasty[new] & (again | np.append(again[1:], False))).any():
            return at
        inside = (at > 0) & (owner[np.maximum(at - 1, 0)] == word)
        left = np.where(inside, symbols[np.maximum(at - 1, 0)], -1)
        touching = again & (np.diff(at, prepend=-9) == 2)
        left[touching] = new[np.flatnonzero(touching) - 1]
        far = np.minimum(at + 2, len(symbols) - 1)
        right = np.where((at + 2 < len(symbols)) & (owner[far] == word), symbols[far], -1)
        mine, opens = self.rank[new], np.zeros(len(at), bool)
        for a, b in ((left, new), (new, right)):
            pair = self.look_up(a, b)
            opens |= (pair >= 0) & (self.rank[pair] <= mine)
        opened = np.cumsum(opens) - opens  # merges before this one that open such a pair
        start = np.maximum.accumulate(np.where(again, 0, np.arange(len(at))))
        return at[opened == opened[start]]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each run of ids: controls are empty, the mark that was put before a text goes, and bytes that are no
        UTF-8 are replaced one by one."""
        out, raw, upto = [], self.raw, 0
        for n in counts.tolist():
            own = ids[upto : upto + n]
            upto += n
            breaks = np.flatnonzero(self.control[own]) if n else own  # a control also ends a run of bytes
            said = np.delete(own, breaks)
            parts = [b"".join(map(raw.__getitem__, part.tolist())) for part in np.split(own, breaks)]
            text = "".join(part.decode("utf-8", "quadrille-each-byte") for part in parts)
            out.append(text[1:] if len(said) and self.marked[said[0]] else text)
        return out


def loaded(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


class Encoder:
    """Encodes chunk after chunk of a task's texts; the ids of words that it has met are kept in one flat array."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self):
        self.known, self.ids, self.start, self.count = {}, np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        if len(self.known) > HELD:
            self.clear()
        cut = [PRE_TOKEN.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        fresh = list(dict.fromkeys(w for w in itertools.chain.from_iterable(cut) if w not in self.known))
        if fresh:
            ids, count = self.pieces.encode_words(fresh)
            self.start = np.concatenate([self.start, len(self.ids) + offsets(count)[:-1]])
            self.known.update(zip(fresh, itertools.count(len(self.count))))
            self.count, self.ids = np.concatenate([self.count, count]), np.concatenate([self.ids, ids])
        words = np.fromiter(map(self.known.__getitem__, itertools.chain.from_iterable(cut)), np.int64)
        count = self.count[words]
        upto = offsets(count)[offsets(np.array([len(c) for c in cut], np.int64))]
        return self.ids[ranges(self.start[words], count)], np.diff(upto)


def _chunks(sizes: list[int]) -> Iterator[slice]:
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > CHUNK_CHARS:
            yield slice(first, i)
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield slice(first, len(sizes))


def _listed(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets(counts).astype(np.int32)), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", decoded: str | None = None) -> DataFrame:
    """key, ids: the ids that the sentencepiece BPE model (a path on every executor) gives each text, without begin or end;
    with `decoded`, also a column of that name, the text that decode() gives for the ids.

    Spaces become marks and one mark is put before a text that is not empty.  A null text is empty and has no ids.  Rows are
    independent, so ties, repeated rows and an empty table need no care; control strings inside texts are ordinary text; a
    very long text is a chunk of its own; other columns are dropped, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        encoder = Encoder(pieces)
        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"].to_pylist()]
            for part in _chunks([*map(len, texts)]):
                ids, counts = encoder(texts[part])
                own = batch["key"].slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([own, _listed(ids, counts), *([pa.array(pieces.decode(ids, counts), pa.string())] if decoded else [])], [*out.names])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = rows.select("key", F.lit(None).cast("array<int>").alias("ids"), *([F.lit(None).cast("string").alias("said")] if decoded else [])).schema
    out = schema
    found = rows.mapInArrow(run, schema)
    return found.select(F.col("key").alias(key), "ids", *([F.col("said").alias(decoded)] if decoded else []))


def decode(encoded: DataFrame, model: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, text: what the model's decoder makes of each list of ids.  A null list, and null ids in one, count as absent; ids
    outside the vocabulary raise an error; other columns are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for batch in batches:
            lists = batch["ids"]
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            texts = pieces.decode(lists.flatten().to_numpy(zero_copy_only=False), counts)
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(texts, pa.string())], ["key", "text"])

    rows = encoded.select(F.col(key).alias("key"), F.filter(F.col(ids).cast("array<int>"), F.isnotnull).alias("ids"))
    return rows.mapInArrow(run, rows.select("key", F.lit("").alias("text")).schema).select(F.col("key").alias(key), "text")
