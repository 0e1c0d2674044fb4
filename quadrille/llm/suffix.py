"""Suffix-array deduplication: bytes covered by a string of WINDOW bytes that also starts elsewhere are removed.

Windows are WINDOW bytes, or shorter where WORDS whole words are in less; those make out repeated passages.  Every window has
an anchor, the GRAM-byte string in it with the least hash (the first of equals).  It depends on the window's bytes only, so
equal windows have equal anchors, and it is enough to look for repeats among the texts around equal anchors.  A segment is a
run of windows with one anchor, with the bytes up to WINDOW after its last start.  Segments that are equal as a whole repeat
in all their windows.  Of anchors with different segments, one text of each is sent to a shard, where the suffix array over
the shard's texts is built by induced sorting, its common prefixes are computed in text order (permuted), and suffixes with a
common prefix as long as a window are repeats.

In windows of words white space counts as equal, and so do the ends of a text; strings of WINDOW bytes are compared byte by
byte.  A repeated string of WINDOW bytes begins with a repeated window, so both are found among the same segments.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SPACE, chunks, cut, join_uneven, lean, mix, powers, prefix_hash, span_hash, utf8

WINDOW, WORDS, GRAM = 400, 51, 64
#: Bytes of a shard on average, and of each of the two blocks that a larger anchor's texts are compared in.
SHARD = 1_000_000
EDGE = 0xFF  # marks the ends of a text; no byte of UTF-8
BLANK = bytes(0x20 if SPACE[c] or c == EDGE else c for c in range(256))
SPANS = ["key", "hash", "first", "last", "from", "to"]
MADE = ("n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "n_repeated")


# --- the suffix array of a shard -----------------------------------------------------------------------------------


def join(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols (byte + 1, and 0 after each text), the place of the text end at or after each symbol, and the text starts.
    The zeros count as different symbols that are ordered by place, so no common prefix goes past a text's end."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    ends = np.cumsum(sizes) - 1
    symbols = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
    symbols[ends] = 0
    return symbols, np.repeat(ends, sizes), ends - sizes + 1


def classify(symbols: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one.  A run of equal symbols is of the type of its last."""
    n = len(symbols)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(symbols[1:].astype(np.int64) - symbols[:-1])
    step[-1] = 1
    step[symbols == 0] = 1
    known = np.where(step != 0, np.arange(n), n)
    known = np.minimum.accumulate(known[::-1])[::-1]
    return step[known] > 0


def deal(to: np.ndarray, items: np.ndarray, symbol: np.ndarray, front: np.ndarray, back: bool) -> None:
    """Put items at the front (or, the other way round, at the back) of the free places of their symbols' buckets, in order."""
    order = np.argsort(symbol, kind="stable")
    symbol = symbol[order]
    first = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
    count = np.diff(np.append(first, len(symbol)))
    nth = np.arange(len(symbol)) - np.repeat(first, count)
    if back:
        to[front[symbol] - 1 - nth] = items[order]
        front[symbol[first]] -= count
    else:
        to[front[symbol] + nth] = items[order]
        front[symbol[first]] += count


def induce(symbols: np.ndarray, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array that follows from the leftmost-smaller suffixes in the given order.

    Buckets are worked off in order, a whole bucket at a time: what a bucket's suffixes are preceded by goes to the front of
    larger buckets (then, backwards, the smaller ones to the back); what falls into the same bucket makes another round.
    """
    n = len(symbols)
    sizes = np.bincount(symbols, minlength=257)
    ends = np.cumsum(sizes)
    heads = ends - sizes
    out = np.full(n, -1, np.int32)
    seeds = np.argsort(symbols[lms], kind="stable")
    seed_ends = np.cumsum(np.bincount(symbols[lms], minlength=257))
    ordered = lms[seeds].astype(np.int32)
    front = heads.copy()
    for c in np.flatnonzero(sizes).tolist():
        done = heads[c]
        while done < front[c]:
            part = out[done : front[c]]
            done = front[c]
            before = part[part > 0] - 1
            before = before[~smaller[before]]
            if len(before):
                deal(out, before, symbols[before], front, False)
        part = ordered[seed_ends[c - 1] if c else 0 : seed_ends[c]]
        before = part[part > 0] - 1
        if len(before):
            deal(out, before, symbols[before], front, False)
    larger_end = front.copy()
    back = ends.copy()
    zeros = sizes[0]
    out[:zeros] = np.flatnonzero(symbols == 0)  # ends of texts, by place
    back[0] = 0
    for c in np.flatnonzero(sizes).tolist()[::-1]:
        if c:
            done = ends[c]
            while done > back[c]:
                part = out[back[c] : done][::-1]
                done = back[c]
                before = part[part > 0] - 1
                before = before[smaller[before] & (symbols[before] > 0)]
                if len(before):
                    deal(out, before, symbols[before], back, True)
            part = out[heads[c] : larger_end[c]][::-1]
            before = part[part > 0] - 1
            before = before[smaller[before] & (symbols[before] > 0)]
            if len(before):
                deal(out, before, symbols[before], back, True)
    return out


def substring_names(symbols: np.ndarray, lms: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    """Names of the leftmost-smaller substrings in text order, ranks in the order in which sorted_ has them; equal ones have
    one name.  A substring's value is a hash of its symbols up to the next one's first; ends of texts differ from each other."""
    place = np.full(len(symbols), -1, np.int64)
    place[lms] = np.arange(len(lms))
    order = place[sorted_]
    order = order[order >= 0]
    up, down = powers(len(symbols) + 1)
    scrambled = mix(symbols.astype(np.uint64) + np.uint64(1))
    zero = np.flatnonzero(symbols == 0)
    scrambled[zero] = mix(zero.astype(np.uint64) + np.uint64(1 << 40))
    prefix = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(scrambled * up[:-1], out=prefix[1:])
    stop = np.append(lms[1:] + 1, len(symbols))
    values = mix((prefix[stop] - prefix[lms]) * down[lms] + (stop - lms).astype(np.uint64))[order]
    names = np.empty(len(lms), np.int64)
    names[order] = np.concatenate([[0], np.cumsum(values[1:] != values[:-1])])
    return names


def sort_names(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of the reduced string of names, whose ranks leave room: a name's rank is the number of suffixes
    before its class.  In each round every name that is not unique is renamed by itself and the ones `reach` and twice as far
    on, and `reach` trebles: the recursion on ever longer leftmost-smaller substrings."""
    ranks, n, reach = names.copy(), len(names), 1
    bits = (n + 1).bit_length()
    ahead = (1, 2) if 3 * bits < 63 else (1,)  # so many ranks go into one number
    while True:
        tied = np.flatnonzero(np.bincount(ranks, minlength=n)[ranks] > 1)
        if not len(tied):
            return np.argsort(ranks)
        padded = np.append(ranks + 1, 0)
        value = ranks[tied]
        for k in ahead:
            value = value << bits | padded[np.minimum(tied + k * reach, n)]
        order = np.argsort(value)
        value = value[order]
        change = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
        own = value[change] >> bits * len(ahead)
        first = np.append(True, own[1:] != own[:-1])
        since = change - np.maximum.accumulate(np.where(first, change, 0))  # of the same name, how many are before
        ranks[tied[order]] = np.repeat(own + since, np.diff(np.append(change, len(value))))
        reach *= len(ahead) + 1


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """All suffixes in order: the leftmost-smaller suffixes are sorted as the suffixes of the string of their substrings' names,
    and induce all others."""
    smaller = classify(symbols)
    lms = np.flatnonzero(smaller & np.concatenate([[False], ~smaller[:-1]])).astype(np.int64)
    if not len(lms):
        return induce(symbols, smaller, lms)
    names = substring_names(symbols, lms, induce(symbols, smaller, lms))
    counts = np.bincount(names)
    return induce(symbols, smaller, lms[sort_names((np.cumsum(counts) - counts)[names])])  # names with room between them


def permuted_prefixes(symbols: np.ndarray, ends: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix in text order its common prefix with the one before it in sorted order, and that one.

    Where both are preceded by the same symbol the value is that of the suffix one to the left less one; only the others
    are compared, eight bytes a step.
    """
    n = len(symbols)
    previous = np.empty(n, np.int64)
    previous[order[1:]] = order[:-1]
    previous[order[0]] = order[0]
    at = np.arange(n)
    left, left_previous = symbols[np.maximum(at - 1, 0)], symbols[np.maximum(previous - 1, 0)]
    own = (at == 0) | (previous == 0) | (left != left_previous) | (left == 0) | (previous == at)
    own[1:] |= previous[1:] != previous[:-1] + 1
    i = np.flatnonzero(own)
    j = previous[i]
    most = np.minimum(ends[i] - i, ends[j] - j)
    most[i == j] = 0
    raw = np.concatenate([(symbols - np.uint16(1)).astype(np.uint8), np.zeros(8, np.uint8)])
    words = np.ndarray(n, "<u8", raw.tobytes(), strides=(1,))
    common = np.zeros(len(i), np.int64)
    going = np.flatnonzero(most > 0)
    while len(going):
        differ = words[i[going] + common[going]] ^ words[j[going] + common[going]]
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) >> 3)
        common[going] += same
        going = going[(same == 8) & (common[going] < most[going])]
    common = np.minimum(common, most)
    values = np.zeros(n, np.int64)
    values[i] = common
    last = np.maximum.accumulate(np.where(own, at, 0))
    return values[last] - (at - last), previous


def framed(text: bytes) -> bytes:
    return b"\xff" + text + b"\xff"


def window_ends(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the window from each byte ends: after WINDOW bytes, or with the blank after WORDS whole words if that is no later;
    and where what it covers ends: without that blank.  A whole word has a blank on both sides in the window."""
    ends = np.arange(len(data)) + WINDOW
    blank = data == 0x20
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    stops = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    stops = stops if not len(data) or blank[0] else stops[1:]
    nth = np.zeros(len(data), np.int64)
    nth[starts] = 1
    nth = np.cumsum(nth) + WORDS - 1
    known = np.flatnonzero(nth < len(stops))
    known = known[stops[nth[known]] + 1 <= ends[known]]
    ends[known] = stops[nth[known]] + 1
    covers = ends.copy()
    covers[known] -= 1
    return ends, covers


def spans(marks: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of marked places: the text that it is in, the run's first place and the end of its last, both in the text."""
    edge = np.flatnonzero(np.diff(marks.astype(np.int8), prepend=0, append=0))
    first, last = edge[::2], edge[1::2] - 1
    row = np.searchsorted(starts, first, "right") - 1
    return row, first - starts[row], ends[last] - starts[row]


def repeated(texts: list[bytes], own: np.ndarray) -> tuple[tuple, tuple]:
    """spans() of the windows in framed texts, or parts of them, that also start elsewhere in the texts, and of the strings of WINDOW
    bytes that do.  own: how many first windows of each text are its own, as the others are of the next segment, too."""
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    symbols, ends, starts = join([t.translate(BLANK) for t in texts])
    order = suffix_array(symbols)
    common, _ = permuted_prefixes(symbols, ends, order)
    places, sizes = np.arange(len(symbols)), np.diff(np.append(starts, len(symbols)))
    mine = places < np.repeat(starts + own, sizes)
    stops, covers = window_ends((symbols - np.uint16(1)).astype(np.uint8))
    windows = np.zeros(len(symbols), bool)
    group = np.cumsum((common < stops - places)[order])  # of suffixes that begin with one window
    at = np.flatnonzero(mine[order])
    count = np.bincount(group[at], minlength=group[-1] + 1)
    windows[order[at[count[group[at]] > 1]]] = True
    # strings of WINDOW bytes that are equal but for white space are told apart by their own bytes
    strings = np.zeros(len(symbols), bool)
    edges = np.append(0, np.cumsum(raw == EDGE))
    whole = np.flatnonzero(windows & (places + WINDOW <= ends))
    whole = whole[edges[whole + WINDOW] == edges[whole]]
    if len(whole):
        value = span_hash(prefix_hash(raw), whole, whole + WINDOW)
        by_value = np.argsort(value)
        same = value[by_value[1:]] == value[by_value[:-1]]
        strings[whole[by_value[np.append(same, False) | np.append(False, same)]]] = True
    return spans(windows, covers, starts), spans(strings, places + WINDOW, starts)


# --- segments --------------------------------------------------------------------------------------------------------


def varying_least(values: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Minimum of the width[i] values from i on, from the minima of two spans of a power of two."""
    out, level, step = np.empty(len(width), np.uint64), values, 1
    while True:
        at = np.flatnonzero((width >= step) & (width < 2 * step))
        out[at] = np.minimum(level[at], level[at + width[at] - step])
        step *= 2
        if not len(width) or step > width.max():
            return out
        level = np.minimum(level[: -(step // 2)], level[step // 2 :])


def segments(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Segments of framed texts: row (of the text), anchor, digest, start, windows, size (bytes that the windows cover, without
    the blank that ends a window of words) and strings (where the last of their strings of WINDOW bytes ends, 0: none)."""
    out = []
    for i, j in chunks(texts):
        whole = b"".join(texts[i:j])
        data = np.frombuffer(whole.translate(BLANK), np.uint8)
        if len(data) <= 2 * WORDS:
            continue
        at = np.arange(len(data) - GRAM + 1)
        grams = span_hash(prefix_hash(data), at, at + GRAM)
        bits = np.uint64(int(len(data)).bit_length())
        ranked = grams >> bits << bits | at.astype(np.uint64)
        ends, covers = window_ends(data)
        ends = ends[: np.searchsorted(ends, len(data), "right")]
        least = varying_least(ranked, ends - np.arange(len(ends)) - GRAM + 1)
        anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        sizes = np.array([len(t) for t in texts[i:j]], np.int64)
        first = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(j - i), sizes)[: len(anchor)]
        inside = ends <= (first + sizes)[row]
        same = np.zeros(len(anchor), bool)
        same[1:] = inside[:-1] & (anchor[1:] == anchor[:-1]) & (row[1:] == row[:-1])
        start = np.flatnonzero(inside & ~same)
        number = np.cumsum(~same & inside) - 1
        count = np.bincount(number[inside], minlength=len(start))
        place, last = anchor[start], start + count - 1
        head, stop = first[row[start]], (first + sizes)[row[start]]
        upto = np.minimum(last + WINDOW, stop)
        shape = (place - start).astype(np.uint64) << np.uint64(32) | count.astype(np.uint64) << np.uint64(16) | (upto - last).astype(np.uint64)
        digest = mix(span_hash(prefix_hash(np.frombuffer(whole, np.uint8)), start, upto) + shape)
        string = np.minimum(last, stop - 1 - WINDOW)  # the last one within the text
        strings = np.where(string >= np.maximum(start, head + 1), string + WINDOW - start, 0)
        out.append((row[start] + i, grams[place].view(np.int64), digest.view(np.int64), start - head, count, covers[last] - start, strings))
    names = ("row", "anchor", "digest", "start", "windows", "size", "strings")
    return {k: np.concatenate([x[m] for x in out]) if out else np.zeros(0, np.int64) for m, k in enumerate(names)}


def _cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of the texts, a few hundred of which are Python values at a time."""
    kinds = {"key": pa.int64(), "hash": pa.int64(), "anchor": pa.int64(), "digest": pa.int64(), "start": pa.int32(), "windows": pa.int32(), "size": pa.int32(), "strings": pa.int32()}
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            found = segments([framed(t) for t in utf8(part.column("text").to_pylist())])
            row = found.pop("row")
            found |= {c: part.column(c).to_numpy(zero_copy_only=False)[row] for c in ("key", "hash")}
            yield pa.RecordBatch.from_arrays([pa.array(found[c]).cast(t) for c, t in kinds.items()], [*kinds])


def _pack(column: str):
    """Texts as compressed UTF-8, so that a shuffle moves and keeps less than half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3, write_content_size=True).compress
        for batch in batches:
            at = batch.schema.names.index(column)
            packed = pa.array([pack(t) for t in utf8(batch.column(at).to_pylist())], pa.binary())
            yield pa.RecordBatch.from_arrays([packed if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)

    return run


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each wanted segment of a packed text."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for i in range(0, len(batch), 256):
            part = batch.iloc[i : i + 256]
            out = []
            for key, text_hash, text, wanted in zip(part["key"].tolist(), part["hash"].tolist(), part["text"], part["segments"]):
                raw = framed(unpack(text))
                out += [(key, text_hash, s["shard"], s["blocks"], s["anchor"], s["digest"], s["start"], s["windows"], raw[s["start"] : s["start"] + s["windows"] - 1 + WINDOW]) for s in wanted]
            yield pd.DataFrame(out, columns=["key", "hash", "shard", "blocks", "anchor", "digest", "start", "windows", "bytes"])


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Repeats among the segments of each (shard, one, two), which follow one another."""
    group, held = None, {}

    def close() -> pd.DataFrame:
        key, text_hash, start, own, texts = zip(*held.values())
        start, out = np.array(start), []
        for (row, first, last), names in zip(repeated(texts, np.array(own)), (SPANS[2:4], SPANS[4:])):
            found = {"key": np.array(key)[row], "hash": np.array(text_hash)[row]} | dict.fromkeys(SPANS[2:], 0)
            out.append(pd.DataFrame(found | {names[0]: start[row] + first, names[1]: start[row] + last}))
        return pd.concat(out)

    for batch in batches:
        columns = [batch[c].tolist() for c in ("shard", "one", "two", "anchor", "digest", "key", "hash", "start", "windows", "bytes")]
        for shard, one, two, anchor, digest, key, text_hash, start, windows, text in zip(*columns):
            if (shard, one, two) != group:
                if held:
                    yield close()
                group, held = (shard, one, two), {}
            held.setdefault((anchor, digest), (key, text_hash, start, windows, bytes(text)))  # repeated rows once
    if held:
        yield close()


def _covered(spans: list[dict], first: str, last: str, size: int) -> np.ndarray:
    gone = np.zeros(size + 1, np.int32)
    np.add.at(gone, [s[first] for s in spans], 1)
    np.add.at(gone, [min(s[last], size) for s in spans], -1)
    return np.cumsum(gone)[:-1] > 0


def _remove(batches: Iterator[pa.RecordBatch], passages: bool) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for whole in batches:
        for i in range(0, whole.num_rows, 1024):
            batch = whole.slice(i, 1024)
            names, out = batch.schema.names, []
            for text, spans in zip(batch.column(names.index("__text")).to_pylist(), batch.column(names.index("__spans")).to_pylist()):
                raw = unpack(text)
                n = n_runs = repeated = 0
                kept = raw
                if spans:
                    strings = _covered(spans, "from", "to", len(raw))
                    every = strings | _covered(spans, "first", "last", len(raw))
                    covered = every if passages else strings
                    n, repeated = int(covered.sum()), int(every.sum())
                    n_runs = int((covered & ~np.concatenate([[False], covered[:-1]])).sum())
                    kept = np.frombuffer(raw, np.uint8)[~covered].tobytes()
                out.append((len(raw), n, n_runs, kept.decode(errors="ignore") if passages else kept, hashlib.sha256(kept).hexdigest(), repeated))
            kinds = (*[pa.int64()] * 3, pa.string() if passages else pa.binary(), pa.string(), pa.int64())
            own = [c for c in names if c not in ("__text", "__spans")]
            made = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(c)) for c in own], *made], [*own, *MADE])


def repeats(rows: DataFrame) -> DataFrame:
    """rows(key long, hash long, text) -> key, hash, first, last, from, to: byte spans that repeated windows cover (first to last)
    and repeated strings of WINDOW bytes (from to to); either can be empty."""
    cuts = cut(rows.mapInArrow(lean(_cut_up), "key long, hash long, anchor long, digest long, start int, windows int, size int, strings int"), "segments")
    groups = cut(cuts.groupBy("anchor", "digest").agg(F.count("*").alias("n"), F.min(F.struct("key", "hash", "start", "windows")).alias("rep")), "groups")
    same = join_uneven(cuts, groups.filter("n > 1").select("anchor", "digest", "n"), ["anchor", "digest"], "n")
    string = lambda c: F.when(F.col("strings") > 0, c).otherwise(0)
    whole = same.select(
        "key", "hash", F.col("start").alias("first"), (F.col("start") + F.col("size")).alias("last"),
        string(F.greatest("start", F.lit(1))).alias("from"), string(F.col("start") + F.col("strings")).alias("to"),
    )
    length = F.col("rep.windows") + WINDOW
    shared = groups.groupBy("anchor").agg(F.count("*").alias("different"), F.sum(length).alias("bytes")).filter("different > 1").drop("different")
    total = shared.agg(F.sum("bytes")).first()[0] or 0
    shards = max(1, total // SHARD)
    blocks = F.ceil(F.col("bytes") / SHARD).cast("int")
    single = F.col("bytes") <= SHARD
    shared = shared.select(
        "anchor",
        F.when(single, F.pmod(F.xxhash64("anchor"), F.lit(shards))).otherwise(F.col("anchor")).alias("shard"),
        F.when(single, 0).otherwise(blocks).alias("blocks"),  # 0: shares its shard with other anchors
    )
    wanted = groups.join(shared, "anchor").select(
        F.col("rep.key").alias("key"), F.col("rep.hash").alias("hash"),
        F.struct("shard", "blocks", "anchor", "digest", F.col("rep.start").alias("start"), F.col("rep.windows").alias("windows")).alias("segment"),
    )
    wanted = wanted.groupBy("key", "hash").agg(F.collect_list("segment").alias("segments"))
    packed = rows.mapInArrow(lean(_pack("text")), "key long, hash long, text binary")
    texts = packed.join(wanted, ["key", "hash"]).mapInPandas(lean(_extract), "key long, hash long, shard long, blocks int, anchor long, digest long, start int, windows int, bytes binary")
    block = F.pmod(F.xxhash64("digest"), F.greatest("blocks", F.lit(1))).cast("int")
    texts = texts.withColumn("block", block).withColumn("with", F.explode(F.expr("sequence(0, greatest(blocks, 1) - 1)")))
    # -1 marks the shards of several anchors
    one = F.when(F.col("blocks") == 0, -1).otherwise(F.least("block", "with"))
    dealt = texts.select("shard", one.alias("one"), F.greatest("block", "with").alias("two"), "anchor", "digest", "key", "hash", "start", "windows", "bytes")
    dealt = dealt.repartition("shard", "one", "two").sortWithinPartitions("shard", "one", "two")
    found = whole.unionByName(dealt.mapInPandas(lean(_search), "key long, hash long, first int, last int, from int, to int"))
    inner = lambda c: F.greatest(F.lit(0), F.col(c) - 1).alias(c)  # noqa: E731  without the ends of the frame
    return found.select("key", "hash", *[inner(c) for c in SPANS[2:]])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", passages: bool = False) -> DataFrame:
    """docs without its text column, and with n_bytes, n_removed, n_spans, kept (the remaining bytes; with passages a string of the
    whole characters among them), kept_sha256 and n_repeated.

    Every byte of a text (as UTF-8) that is covered by a string of WINDOW bytes which also starts anywhere else, in another
    row or in the same, is removed; overlaps count; strings are judged on the input.  With passages, so many whole WORDS
    (runs without ASCII white space) that start elsewhere are removed in less than WINDOW bytes, too; white space counts as
    equal there, a text's ends as white space, and the one after the last of those words stays.  n_repeated is the number
    of bytes that passages removes.  A null text is empty; texts under WINDOW bytes, or with passages under WORDS words,
    lose nothing; rows with equal keys and texts are repeated rows, whose windows all start elsewhere; an empty table gives
    no rows; columns of docs with names of the new ones give way.  Keys must be integers; null is one.
    """
    row_key, row_hash = F.coalesce(F.col(key).cast("long"), F.lit(-1 << 63)), F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    if docs.groupBy(row_key).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        row_hash = F.lit(0).cast("long")  # keys tell rows apart, so no digest travels with every segment
    rows = docs.select(row_key.alias("key"), row_hash.alias("hash"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spans = repeats(rows).groupBy("key", "hash").agg(F.collect_set(F.struct(*SPANS[2:])).alias("__spans")).select(F.col("key").alias("__key"), F.col("hash").alias("__hash"), "__spans")
    kept = [c for c in docs.columns if c != text and c not in MADE]
    whole = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias("__text"), row_key.alias("__key"), row_hash.alias("__hash"))
    fields = ", ".join(f"`{c}` {'binary' if c == '__text' else whole.schema[c].dataType.simpleString()}" for c in whole.columns)
    whole = whole.mapInArrow(lean(_pack("__text")), fields).join(spans, ["__key", "__hash"], "left").drop("__key", "__hash")
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    kind = "string" if passages else "binary"
    return whole.mapInArrow(lean(lambda batches: _remove(batches, passages)), f"{schema}, n_bytes long, n_removed long, n_spans long, kept {kind}, kept_sha256 string, n_repeated long")


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """docs with texts of the bytes that remove_repeats() with passages keeps, and length (where there is such a column) as
    their number of characters.  What is left of a character that was cut apart goes too; a null text becomes empty."""
    own = {c: c if c in (key, text) else f"__own{k}" for k, c in enumerate(docs.columns)}  # no name of theirs gives way
    told = remove_repeats(docs.select(*[F.col(f"`{c}`").alias(o) for c, o in own.items()]), key, text, passages=True)
    columns = {text: F.col("kept")} | ({length: F.length("kept").cast(docs.schema[length].dataType)} if length in docs.columns else {})
    return told.select(*[columns.get(c, F.col(o)).alias(c) for c, o in own.items()])
