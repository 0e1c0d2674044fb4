"""Helpers that the operators share: hashing of whitespace words and of byte spans in numpy, and joins on uneven keys."""

import contextlib
import ctypes

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_dir, written as cut  # noqa: F401

#: ASCII white space of the word pattern `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Word pattern for Spark's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"

_CHUNK = 1 << 19  # bytes hashed at a time
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser published with splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)  # a random value for each byte
_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_POWERS.get("up", ())) < n:
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(max(n, _CHUNK + 1), base, np.uint64)
            p[0] = 1
            _POWERS[key] = np.cumprod(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash of bytes, one longer than data."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end)."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


def utf8(texts) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


def chunks(texts: list[bytes]):
    """(first, last) of runs of texts with about _CHUNK bytes."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > _CHUNK:
            yield first, i
            first, held = i, 0
        held += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def words(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and how many each text has."""
    hashes, counts = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
    for i, j in chunks(texts):
        data = b"\n".join(texts[i:j]) + b"\n"
        data = np.frombuffer(data.translate(LOWER) if lower else data, np.uint8)
        inside = ~SPACE[data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate([[0], edge])
        start, end = edge[::2], edge[1::2]
        hashes.append(span_hash(prefix_hash(data), start, end))
        stops = np.cumsum([len(t) + 1 for t in texts[i:j]])
        counts[i:j] = np.diff(np.searchsorted(start, stops), prepend=0)
    return np.concatenate(hashes), counts


def offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i]+1, ... count[i] values for each i, one after the other."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(count) - count
    return np.arange(total) + np.repeat(start - first, count)


def release() -> None:
    """Give freed memory back to the system, where the C library can."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(task):
    """A task over batches that gives back its memory when it ends: Spark keeps its Python workers, and an executor's memory holds
    those of earlier stages, too."""

    def run(batches):
        yield from task(batches)
        release()

    return run


#: Keys that more than one in so many rows have are joined by a broadcast; there are fewer of them than that.
HOT_KEYS = 20_000


def join_uneven(rows: DataFrame, found: DataFrame, on: list[str], n: str, how: str = "inner") -> DataFrame:
    """rows joined ("inner" or "left") with found, which has each key once and, as n, how many of the rows have it at most.

    Keys with many rows stay where they are, as their part of found is broadcast: no more than HOT_KEYS rows, as each stands
    for more than one in HOT_KEYS of the sum of n.  The others meet in a shuffle, where no task gets many rows of one key.
    """
    limit = (found.agg(F.sum(n)).first()[0] or 0) // HOT_KEYS
    hot, cold = F.broadcast(found.filter(F.col(n) > limit)), found.filter(F.col(n) <= limit)
    rest = rows.join(hot.select(*on), on, "left_anti").join(cold.hint("merge"), on, how)
    return rows.join(hot, on).unionByName(rest)
