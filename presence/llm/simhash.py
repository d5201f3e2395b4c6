"""Near-duplicate documents by SimHash and a byte-position inverted index.

A fingerprint has 64 bits; bit k is 1 if it is set in over half of the XXH64
values (seed 42) of the text's word shingles, repeats included. Fingerprints
that differ in at most DISTANCE = 2 bits share at least 8 - 2 = 6 of their 8
positional bytes. The index holds postings by positional bytes: by sets of
four positions at a time, since a posting of one byte holds 1/256 of all
rows. Any two positions lie outside one of the six sets, so two fingerprints
that share six positional bytes meet in a posting. There the shared
positional bytes of each pair are tallied, pairs with fewer than six are
dropped by the count, and the rest are verified on their bits.

Only distinct fingerprints are indexed. A posting of more than POSTING of
them is not compared pair by pair: each of its members is listed under itself
and its 64 one-bit variants instead. Fingerprints two bits apart have a
variant in common, and one variant has at most 65 holders, all linked with
each other, so lists stay short whatever the data, and no link is lost.

Nulls: a null text is empty; texts without words have fingerprint zero and
are linked like any other. A null id is a document of its own, linked with
nothing. Repeated rows stay rows. Empty tables give no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presence.llm.components import components
from presence.llm.textkit import Words, per_slice, stored

SEED = 42
BYTES, DISTANCE = 8, 2
# Sets of four of the eight byte positions, such that any two
# positions are missed by one of them.
POSITIONS = ((0, 1, 2, 3), (0, 1, 4, 5), (0, 1, 6, 7), (2, 3, 4, 5), (2, 3, 6, 7), (4, 5, 6, 7))
POSTING = 256
SHINGLES = 1 << 16
PAIRS = 1 << 20

assert all(any(not set(two) & set(p) for p in POSITIONS) for two in combinations(range(BYTES), DISTANCE))


def fingerprint(text: bytes, starts: np.ndarray, ends: np.ndarray, shingle: int) -> int:
    """Of one text whose words are the spans of ``text``, joined by one byte."""
    n = len(starts)
    if not n:
        return 0
    size = min(n, shingle)
    begin, end = starts[: n - size + 1], ends[size - 1 :]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(begin), SHINGLES):
        part = zip(begin[k : k + SHINGLES].tolist(), end[k : k + SHINGLES].tolist(), strict=True)
        h = np.array([xxhash.xxh64_intdigest(text[s:e], SEED) for s, e in part], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(begin)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp long): the fingerprint of every row."""

    def work(batch: pa.RecordBatch, words: Words) -> pa.RecordBatch:
        # the words of the slice, one space between them
        size = words.ends - words.starts
        to = np.cumsum(size + 1) - 1
        text = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
        from_ = to - size
        inside = np.ones(len(text), bool)
        inside[to] = False
        marks = np.zeros(len(words.data) + 1, np.int8)
        marks[words.starts] += 1
        marks[words.ends] -= 1
        text[inside] = words.data[np.cumsum(marks[:-1], dtype=np.int8) > 0]
        raw, first = text.tobytes(), words.first
        fps = [fingerprint(raw, from_[a:b], to[a:b], shingle) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(per_slice("text", work), "doc_id long, fp long")


def _linked(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of the lists that differ in at most DISTANCE bits: byte
    tallies first, then bits."""
    sizes = np.array([len(x) for x in lists])
    flat, first = np.concatenate(lists).view(np.uint64), np.cumsum(sizes) - sizes
    # every member meets those behind it in its list
    place = np.arange(len(flat)) - np.repeat(first, sizes)
    behind = np.repeat(sizes, sizes) - place - 1
    left = np.repeat(np.arange(len(flat)), behind)
    right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(behind) - behind, behind)
    differ = flat[left] ^ flat[right]
    shared = (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
    some = np.flatnonzero(shared >= BYTES - DISTANCE)
    some = some[np.bitwise_count(differ[some]) <= DISTANCE]
    return left[some], right[some]


def _spanning(lists: list[np.ndarray]) -> np.ndarray:
    """Links that join what the lists' linked pairs join: fewer than members."""
    left, right = _linked(lists)
    flat = np.concatenate(lists)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            root[y] = x
            out.append((flat[a], flat[b]))
    return np.array(out, np.int64).reshape(-1, 2)


def _compared(batches):
    for batch in batches:
        group, cost = [], 0
        lists = [np.asarray(x, np.int64) for x in batch.column(0).to_pylist()]
        for k, one in enumerate(lists):
            group.append(one)
            cost += len(one) * len(one) // 2
            if cost >= PAIRS or k == len(lists) - 1:
                pairs = _spanning(group)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
                group, cost = [], 0


def _posted(nodes: DataFrame) -> DataFrame:
    """(fp, key): a posting's key is the number of its set of positions and
    the four bytes there; byte p is bits 8p to 8p + 7."""
    byte = lambda p: f"(shiftrightunsigned(fp, {8 * p}) & 255)"
    keys = [
        " | ".join([f"shiftleft({k}L, 32)", *(f"shiftleft({byte(p)}, {8 * at})" for at, p in enumerate(positions))])
        for k, positions in enumerate(POSITIONS)
    ]
    return nodes.select("fp", F.explode(F.expr(f"array({', '.join(keys)})")).alias("key"))


def links(nodes: DataFrame, posting: int = POSTING) -> DataFrame:
    """(a, b) links whose components are those of all pairs of the distinct
    ``fp`` that differ in at most two bits."""
    posted = _posted(nodes)
    sizes = posted.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = stored(posted.join(sizes, "key"), "postings")
    # at most `posting` members each
    lists = met.filter(F.col("n") <= posting).groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")
    small = lists.mapInArrow(_compared, "a long, b long")
    hot = met.filter(F.col("n") > posting).select("fp").distinct()
    variant = F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), k -> fp ^ shiftleft(1L, k)))"))
    listed = hot.select("fp", variant.alias("variant"))
    held = listed.groupBy("variant").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a != z").select("variant", "a")
    return small.unionByName(listed.join(held, "variant").filter("fp != a").select("a", F.col("fp").alias("b")))


def near_duplicates(docs: DataFrame, shingle: int = 3, posting: int = POSTING) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``: 16 hex
    digits, and the smallest doc_id reachable over links."""
    light = stored(fingerprints(docs, shingle), "fingerprints")
    named = light.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("doc"))
    nodes = stored(named, "nodes")
    labels = components(links(nodes.select("fp"), posting)).withColumnRenamed("node", "fp")
    rooted = nodes.join(labels, "fp", "left").select("fp", F.coalesce("label", "fp").alias("root"), "doc")
    least = rooted.groupBy("root").agg(F.min("doc").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return light.join(classes, "fp", "left").select("doc_id", digits.alias("fingerprint"), component.alias("component_id"))
