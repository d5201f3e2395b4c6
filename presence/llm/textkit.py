"""Whole texts as arrays of word hashes, inside Arrow tasks.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Null texts are empty.
Texts are cut into slices of rows of about ``SLICE`` bytes, so the arrays of
a task stay small whatever the size of an Arrow batch; one longer text is a
slice of its own, hashed piece by piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presence.session import shared_folder

SLICE = 1 << 20
PIECE = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Letters, digits and every byte of a character outside ASCII.
SOLID = np.zeros(256, bool)
SOLID[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = np.cumprod(np.r_[np.uint64(1), np.full(2 * PIECE, BASE, np.uint64)])
_INVERSE = np.cumprod(np.r_[np.uint64(1), np.full(2 * PIECE, pow(BASE, -1, 1 << 64), np.uint64)])


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; spans ascend and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    starts, ends = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
    while at < len(starts):
        base = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, base + PIECE, "right")))
        if stop == at + 1 and ends[at] - base > PIECE:
            out[at] = xxhash.xxh64_intdigest(data[base : ends[at]].tobytes())
        else:
            part = data[base : ends[stop - 1]].astype(np.uint64)
            part += np.uint64(1)
            part *= _POWERS[: len(part)]
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part, out=total[1:])
            s, e = starts[at:stop] - base, ends[at:stop] - base
            out[at:stop] = (total[e] - total[s]) * _INVERSE[s]
        at = stop
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Words:
    """Words of a slice of rows: byte spans, and each row's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool):
        self.raw = data
        self.data = LOWER[data] if fold else data
        self.offsets = offsets
        inside = ~SPACE[data]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        full = offsets[:-1][offsets[1:] > offsets[:-1]]
        begin[full] = inside[full]
        last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        end[last] = inside[last]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = hash_spans(self.data, self.starts, self.ends)
        return self._hash

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def cores(self) -> tuple[np.ndarray, np.ndarray]:
        """Spans of the words without ASCII signs at either end; a word of
        signs only has an empty span."""
        solid = np.flatnonzero(SOLID[self.data])
        if not len(solid):
            return self.starts, self.starts
        count = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(SOLID[self.data], out=count[1:])
        before, upto = count[self.starts], count[self.ends]
        some = upto > before
        s = np.where(some, solid[np.minimum(before, len(solid) - 1)], self.starts)
        e = np.where(some, solid[np.maximum(upto - 1, 0)] + 1, self.starts)
        return s, e

    def windows(self, size: int, values: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all runs of ``size`` words, the word each begins at, and
        each row's first run. A row with fewer words is one run; one without
        words has none."""
        h = self.hash if values is None else values
        n = np.diff(self.first)
        count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
        first = np.r_[0, np.cumsum(count)]
        at = np.arange(first[-1]) + np.repeat(self.first[:-1] - first[:-1], count)
        short = np.flatnonzero((n > 0) & (n < size))
        out = np.zeros(len(at), np.uint64)
        for j in range(size):
            out ^= h.take(at + j, mode="clip") if len(at) else out
            out *= np.uint64(0xFF51AFD7ED558CCD)
            out ^= out >> np.uint64(29)
        for r in short:
            value = n[r : r + 1].astype(np.uint64)
            for x in h[self.first[r] : self.first[r + 1]]:
                value = mix(value ^ x) * np.uint64(0xFF51AFD7ED558CCD)
            out[first[r]] = value[0]
        return mix(out), at, first


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column without nulls."""
    col = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(col.cast(pa.string()) if not pa.types.is_string(col.type) else col, "")


def slices(col: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, one row at least."""
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1] if len(col) else [0]
    at = 0
    while at < len(col):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(stop, len(col))
        at = stop


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if col.buffers()[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(col.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words_of(col: pa.Array, fold: bool = True) -> Words:
    return Words(*raw(col), fold)


def per_slice(name: str, work: Callable[[pa.RecordBatch, Words], pa.RecordBatch], fold: bool = True, limit: int = SLICE):
    """A mapInArrow function that hands on slices of rows with their words."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            col = column(batch, name)
            for a, b in slices(col, limit):
                out = work(batch.slice(a, b - a), words_of(col.slice(a, b - a), fold))
                if out.num_rows:
                    yield out

    return run


def lists(values: np.ndarray, counts: np.ndarray, kind=None) -> pa.ListArray:
    offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values) if kind is None else pa.array(values, kind))


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Compute once, as Parquet in the folder that all executors share."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


FILTER_BITS = 1 << 26
FILTER_BLOCKS = 256


def _filter_places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mask = np.uint64(FILTER_BITS // FILTER_BLOCKS - 1)
    block = (h >> np.uint64(48)) & np.uint64(FILTER_BLOCKS - 1)
    return block.astype(np.int64), (h & mask).astype(np.int64), ((h >> np.uint64(20)) & mask).astype(np.int64)


def hash_filter(hashes: DataFrame) -> np.ndarray:
    """A filter of the well mixed 64-bit hashes in column ``h``, as packed
    bits. Its size is fixed, so the driver and the tasks that load it hold
    8 MiB however many hashes there are; with tens of millions of them it lets
    more others pass, but never fewer of its own."""
    per = FILTER_BITS // FILTER_BLOCKS

    def folded(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            block, a, b = _filter_places(batch.column(0).to_numpy().view(np.uint64))
            for k in np.unique(block).tolist():
                flags = held.setdefault(k, np.zeros(per, bool))
                flags[a[block == k]] = flags[b[block == k]] = True
        for k, flags in held.items():
            bits = zlib.compress(np.packbits(flags, bitorder="little").tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([bits])], names=["k", "bits"])

    # the expression repeats _filter_places: all hashes of a block meet
    dealt = hashes.select("h").repartition(F.shiftrightunsigned("h", 48).bitwiseAND(F.lit(FILTER_BLOCKS - 1)))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in dealt.mapInArrow(folded, "k long, bits binary").collect():  # at most FILTER_BLOCKS rows
        out[r["k"] * per // 8 : (r["k"] + 1) * per // 8] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return out


def in_filter(h: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which hashes may be among those of the filter."""
    block, a, b = _filter_places(h)
    base = block * (FILTER_BITS // FILTER_BLOCKS)
    a, b = base + a, base + b
    return (held[a >> 3] >> (a & 7) & 1 & (held[b >> 3] >> (b & 7))).astype(bool)


def lookup(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """For each value its place in ``known`` (sorted, distinct), or -1. A
    table of the low 16 bits settles nearly all values that are not known."""
    maybe = np.zeros(1 << 16, bool)
    maybe[(known & np.uint64(0xFFFF)).astype(np.int64)] = True
    out = np.full(len(values), -1, np.int64)
    at = np.flatnonzero(maybe[(values & np.uint64(0xFFFF)).astype(np.int64)])
    place = np.minimum(np.searchsorted(known, values[at]), max(len(known) - 1, 0))
    if len(known):
        good = known[place] == values[at]
        out[at[good]] = place[good]
    return out


def word_hashes(terms: list[str]) -> np.ndarray:
    """The hashes that lower-cased words get."""
    if not terms:
        return np.zeros(0, np.uint64)
    words = words_of(pa.array(["\n".join(terms)]))
    return words.hash


def crc_mod(col, n: int):
    """crc32 of the id's decimal text, modulo n: the split of labelled rows."""
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(n))
