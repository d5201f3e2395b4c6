"""Near-duplicate documents by HyperMinHash.

A document's set is its distinct word shingles (64-bit hashes). Registers: the
top bits of a hash pick one of 256; a register keeps the smallest remainder,
compressed to its leading-zero count and ten mantissa bits (two bytes). Empty
registers borrow from others in an order fixed by their number, so short
texts can be banded too. Bands of six registers join documents: two sets of
similarity 0.8 share none of the 42 bands with probability 3e-6.

Equal sets are one node. In a band, every node is first held against one of
the band's nodes, drawn by hash. Bands whose nodes then lie in more than one component
are compared in blocks, across components only: nodes with a partner whose
Jaccard estimate, corrected for register collisions, is within five standard
deviations of the threshold fetch their full sets, and a block hands on the
links that join its components. All links are confirmed on the full sets.

Nulls: a null text is empty; a null id is a document of its own, linked with
nothing. Repeated rows with one id are one document. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presence.llm.components import components
from presence.llm.textkit import Words, lists, mix, per_slice, stored

BUCKET_BITS = 8
REGISTERS = 1 << BUCKET_BITS
MANTISSA = 10
ROWS = 6
BANDS = REGISTERS // ROWS
BLOCK = 512
GROUP = 1 << 22
SMALL = 64
# Expected share of registers that agree by chance, from the HyperMinHash
# paper's closed form for sets of like size.
CHANCE = 0.169919487159739 * 2.0 ** (1 - MANTISSA)

SetsOf = Callable[[DataFrame], DataFrame]

SKETCH = "doc_id long, n_shingles long, fp binary, regs binary"

# Where an empty register looks, in this order; the last resort is the first
# filled one.
_ORDER = (mix(np.arange(64 * REGISTERS, dtype=np.uint64)) % np.uint64(REGISTERS)).astype(np.int64).reshape(64, REGISTERS)


def unique_rows(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, ascending, and how many."""
    n = len(first) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    order = np.argsort(values)
    row = row[order].astype(np.uint16 if n <= 1 << 16 else np.int64)  # two bytes sort in linear time
    by_row = np.argsort(row, kind="stable")
    values, row = values[order[by_row]], row[by_row]
    lead = np.ones(len(values), bool)
    lead[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[lead], np.bincount(row[lead], minlength=n).astype(np.int64)


def fixed_binary(rows: np.ndarray, known: np.ndarray | None = None) -> pa.Array:
    """Rows of numbers as binary values of one length, null where not known."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int64) * width
    if len(rows) and offsets[-1] > np.iinfo(np.int32).max:
        return pa.array([r.tobytes() for r in rows], pa.binary(), mask=None if known is None else ~known)
    mask = None if known is None else pa.array(known).buffers()[1]
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [mask, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(rows)])


def registers(values: np.ndarray, counts: np.ndarray, bits: int = BUCKET_BITS) -> np.ndarray:
    """(rows, 2 ** bits) compressed registers; rows without values are 0."""
    width = 1 << bits
    row = np.repeat(np.arange(len(counts)), counts)
    bucket = (values >> np.uint64(64 - bits)).astype(np.int64)
    place = row * width + bucket
    lead = np.r_[True, place[1:] != place[:-1]] if len(place) else np.zeros(0, bool)
    rest = (values[lead] << np.uint64(bits)) >> np.uint64(bits)
    length = np.frexp(rest.astype(np.float64))[1].astype(np.int64)  # bits in use
    down = np.maximum(length - 1 - MANTISSA, 0).astype(np.uint64)
    up = np.maximum(MANTISSA + 1 - length, 0).astype(np.uint64)
    mantissa = ((rest >> down) << up) & np.uint64((1 << MANTISSA) - 1)
    zeros = np.clip(64 - bits - length, 0, 62).astype(np.uint64)
    out = np.zeros(len(counts) * width, np.uint16)
    out[place[lead]] = ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16) + np.uint16(1)
    out = out.reshape(-1, width)
    filled = out > 0
    r, c = np.nonzero(~filled & (counts > 0)[:, None])
    for order in _ORDER[:, :width] % width:
        if not len(r):
            break
        source = order[c]
        take = filled[r, source]
        out[r[take], c[take]] = out[r[take], source[take]]
        r, c = r[~take], c[~take]
    else:
        out[r, c] = out[r, np.argmax(filled[r], axis=1)]
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimate of register rows, corrected for chance agreement."""
    return np.clip(((a == b).mean(axis=-1) - CHANCE) / (1 - CHANCE), 0, 1)


def least_estimate(smaller: np.ndarray, threshold: float, width: int) -> np.ndarray:
    """Estimates below this are five standard deviations under the threshold."""
    return threshold - 5 * np.sqrt(threshold * (1 - threshold) * (1 / width + 1 / np.maximum(smaller, 1)))


def _prints(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """16 bytes that stand for a whole set; null for the empty one."""
    scrambled = mix(values ^ np.uint64(0x5851F42D4C957F2D))
    out = np.zeros((len(counts), 2), np.uint64)
    some = counts > 0
    begin = (np.cumsum(counts) - counts)[some]
    if len(begin):
        out[some, 0], out[some, 1] = np.add.reduceat(values, begin), np.add.reduceat(scrambled, begin)
    return fixed_binary(out, some)


def _ids(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(batch.schema.get_field_index("doc_id"))


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    def work(batch: pa.RecordBatch, words: Words) -> pa.RecordBatch:
        values, _, first = words.windows(shingle)
        values, counts = unique_rows(values, first)
        regs = registers(values, counts)
        return pa.RecordBatch.from_arrays(
            [
                _ids(batch),
                pa.array(counts),
                _prints(values, counts),
                fixed_binary(regs, counts > 0),
            ],
            names=["doc_id", "n_shingles", "fp", "regs"],
        )

    return _input(docs).mapInArrow(per_slice("text", work), SKETCH)


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    def work(batch: pa.RecordBatch, words: Words) -> pa.RecordBatch:
        values, _, first = words.windows(shingle)
        values, counts = unique_rows(values, first)
        return pa.RecordBatch.from_arrays(
            [_ids(batch), _prints(values, counts), lists(values.view(np.int64), counts)], names=["doc_id", "fp", "shingles"]
        )

    return docs.mapInArrow(per_slice("text", work), "doc_id long, fp binary, shingles array<long>")


def _banded(nodes: DataFrame, rows: int, bands: int) -> DataFrame:
    width = 2 * rows
    key = F.expr(f"explode(transform(sequence(0, {bands - 1}), i -> xxhash64(i, substring(regs, i * {width} + 1, {width}))))")
    return nodes.select("node", key.alias("key"))


def _near(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) whose registers make them likely."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (2, 3))
            n = np.minimum(batch.column(4).to_numpy(), batch.column(5).to_numpy())
            big = np.maximum(batch.column(4).to_numpy(), batch.column(5).to_numpy())
            good = (estimate(a, b) >= least_estimate(n, threshold, a.shape[1])) & (n >= threshold * big)
            yield batch.select([0, 1]).filter(pa.array(good))

    side = lambda x: nodes.select(F.col("node").alias(x), F.col("regs").alias(f"regs_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    full = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "regs_a", "regs_b", "n_a", "n_b")
    return full.mapInArrow(run, "a long, b long")


def _confirm(pairs: DataFrame, nodes: DataFrame, sets_of: SetsOf, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold, in whole numbers."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = nodes.join(ends, "node", "left_semi").select(F.col("node").alias("id"), "fp")
    sets = sets_of(wanted).dropDuplicates(["id", "fp"])
    side = lambda x: sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s_{x}"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    every = F.size("s_a") + F.size("s_b") - both
    return pairs.join(side("b"), "b").join(side("a"), "a").filter(100 * both >= percent * every).select("a", "b")


def _grouped(rows: DataFrame, columns: list[str], work, schema: str) -> DataFrame:
    """``work(batch)`` over whole cells, as many at a time as hold GROUP bytes
    in the last of the first four columns, streamed from sorted partitions; a
    cell has at most two blocks of rows."""

    def groups(held: list[pa.RecordBatch]):
        whole = pa.Table.from_batches(held).combine_chunks()
        col = whole.column(3)
        size = pc.multiply(pc.list_value_length(col), 8) if pa.types.is_list(col.type) else pc.binary_length(col)
        before = np.r_[0, np.cumsum(size.to_numpy().astype(np.int64))]
        edges = _edges(whole.column(0).to_numpy())
        at = 0
        while at < len(edges) - 1:
            stop = max(at + 1, int(np.searchsorted(before[edges], before[edges[at]] + GROUP, "right")) - 1)
            stop = min(stop, len(edges) - 1)
            yield from work(whole.slice(edges[at], edges[stop] - edges[at]).combine_chunks())
            at = stop

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column(0).to_numpy()
            lead = int(np.searchsorted(cells, cells[-1]))
            if lead:  # the last cell may go on
                yield from groups([*held, batch.slice(0, lead)])
                held = []
            elif held and held[-1].column(0)[-1].as_py() != cells[0]:
                yield from groups(held)
                held = []
            held.append(batch.slice(lead))
        if held:
            yield from groups(held)

    dealt = rows.select(*columns).repartition(columns[0]).sortWithinPartitions(*columns[:3])
    return dealt.mapInArrow(run, schema)


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, and the end."""
    lead = np.ones(len(columns[0]), bool)
    lead[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return np.r_[np.flatnonzero(lead), len(lead)]


def _expanded(begin: np.ndarray, count: np.ndarray, most: int):
    """(i, j) arrays of each row i with the ``count`` places from ``begin``,
    about ``most`` at a time."""
    total = np.r_[0, np.cumsum(count)]
    at = 0
    while at < len(count):
        stop = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        if n := int(total[stop] - total[at]):
            i = np.repeat(np.arange(at, stop), count[at:stop])
            yield i, np.arange(n) + np.repeat(begin[at:stop] - (total[at:stop] - total[at]), count[at:stop])
        at = stop


def _promising(group: pa.Table, threshold: float):
    """Nodes with a likely partner in another component of their cell: a row
    per node at most, however many the partners."""
    cells, labels, n = (group.column(i).to_numpy() for i in (0, 1, 4))
    regs = np.frombuffer(b"".join(group.column(3).to_pylist()), np.uint16).reshape(len(cells), -1)
    edges, runs = _edges(cells), _edges(cells, labels)
    # labels are sorted: everything in another component lies behind
    begin = np.repeat(runs[1:], np.diff(runs))
    count = np.repeat(edges[1:], np.diff(edges)) - begin
    flag = np.zeros(len(cells), bool)
    for i, j in _expanded(begin, count, GROUP // regs.itemsize // regs.shape[1]):
        good = np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j])
        i, j = i[good], j[good]
        good = estimate(regs[i], regs[j]) >= least_estimate(np.minimum(n[i], n[j]), threshold, regs.shape[1])
        flag[i[good]] = flag[j[good]] = True
    yield from group.select([0, 1, 2]).filter(pa.array(flag)).to_batches()


def _bridges(group: pa.Table, percent: int):
    """Links on full sets that join the components of each cell: at most one
    fewer than it has components."""
    edges = _edges(group.column(0).to_numpy())
    small = np.repeat(np.diff(edges) <= SMALL, np.diff(edges))
    if small.any():
        yield _bridges_of_small(group.filter(pa.array(small)).combine_chunks(), percent)
    for s, e in zip(edges[:-1], edges[1:], strict=True):
        if e - s > SMALL:
            yield _bridges_of_one(group.slice(s, e - s), percent)


def _sets(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labels, ids, sizes of the sets, and their values one after the other."""
    col = group.column(3)
    sizes = pc.list_value_length(col).to_numpy().astype(np.int64)
    return group.column(1).to_numpy(), group.column(2).to_numpy(), sizes, pc.list_flatten(col).to_numpy()


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


class _Roots:
    """Union by the smallest, over few things."""

    def __init__(self, n: int):
        self.of = list(range(n))

    def find(self, x: int) -> int:
        while self.of[x] != x:
            self.of[x] = self.of[self.of[x]]
            x = self.of[x]
        return x

    def join(self, a: int, b: int) -> bool:
        x, y = self.find(a), self.find(b)
        self.of[max(x, y)] = min(x, y)
        return x != y


def _bridges_of_small(group: pa.Table, percent: int) -> pa.RecordBatch:
    """Of many cells of at most SMALL rows, all at once: common shingles are
    counted for every pair of rows of a cell."""
    cells = group.column(0).to_numpy()
    labels, ids, sizes, values = _sets(group)
    edges = _edges(cells)
    rows = np.diff(edges)
    cell = np.repeat(np.arange(len(rows)), rows)
    # a slot for each row and each row of its cell
    slots = np.r_[0, np.cumsum(np.repeat(rows, rows))]
    base = slots[:-1] - edges[cell]
    owner = np.repeat(np.arange(len(cells)), sizes)
    order = np.argsort(values)
    kind = np.uint16 if len(rows) <= 1 << 16 else np.int64  # two bytes sort in linear time
    order = order[np.argsort(cell[owner[order]].astype(kind), kind="stable")]
    owner, values = owner[order], values[order]
    runs = _edges(cell[owner], values)
    behind = np.repeat(runs[1:], np.diff(runs)) - np.arange(len(owner)) - 1
    both = np.zeros(slots[-1], np.int64)
    for i, j in _expanded(np.arange(len(owner)) + 1, behind, GROUP // 8):
        a, b = np.minimum(owner[i], owner[j]), np.maximum(owner[i], owner[j])
        at = base[a] + b
        low = int(at.min())
        counted = np.bincount(at - low)
        both[low : low + len(counted)] += counted
    some = np.flatnonzero(both)
    a = np.searchsorted(slots, some, "right") - 1
    b = some - base[a]
    good = (100 * both[some] >= percent * (sizes[a] + sizes[b] - both[some])) & (labels[a] != labels[b])
    a, b = a[good], b[good]
    # components of a cell, numbered over all cells
    run = _edges(cells, labels)
    number = np.repeat(np.arange(len(run) - 1), np.diff(run))
    roots = _Roots(len(run) - 1)
    keep = [k for k, (x, y) in enumerate(zip(number[a].tolist(), number[b].tolist(), strict=True)) if roots.join(x, y)]
    return _pairs(ids[a[keep]], ids[b[keep]])


def _bridges_of_one(group: pa.Table, percent: int) -> pa.RecordBatch:
    """Of one large cell: intersections are counted through its own index of
    shingles, row by row until its components are joined."""
    labels, ids, sizes, values = _sets(group)
    _, where = np.unique(labels, return_inverse=True)
    roots = _Roots(where.max() + 1)
    _, value = np.unique(values, return_inverse=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)[np.argsort(value, kind="stable")]
    first = np.r_[0, np.cumsum(np.bincount(value))]
    begin = np.r_[0, np.cumsum(sizes)]
    commonest = np.argmax(np.bincount(where))
    left = len(roots.of) - 1
    out: list[tuple[int, int]] = []
    for i in np.flatnonzero(where != commonest):
        if not left:
            break
        own = value[begin[i] : begin[i + 1]]
        count = first[own + 1] - first[own]
        at = np.arange(count.sum()) + np.repeat(first[own] - np.r_[0, np.cumsum(count)[:-1]], count)
        both = np.bincount(owner[at], minlength=len(sizes))
        for j in np.flatnonzero(100 * both >= percent * (sizes + sizes[i] - both)):
            if roots.join(int(where[i]), int(where[j])):
                left -= 1
                out.append((int(i), int(j)))
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return _pairs(ids[pairs[:, 0]], ids[pairs[:, 1]])


def _across(keys: DataFrame, labelled: DataFrame, nodes: DataFrame, sets_of: SetsOf, percent: int) -> DataFrame:
    """Links (a, b) that share a band and join different components.

    A band's nodes are dealt to blocks of about BLOCK by hash and each pair
    of blocks is a cell, so no task holds a whole band. Registers first tell
    which nodes of a cell have a likely partner; only their full sets are
    fetched and compared, inside the cell.
    """
    of = keys.join(labelled, "node")
    mixed = of.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).filter("lo != hi")
    cells = (
        of.join(mixed.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("g")), "key")
        .withColumn("x", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
        .withColumn("y", F.explode(F.expr("sequence(0, g - 1)")))
        .select("node", "label", F.xxhash64("key", F.least("x", "y"), F.greatest("x", "y")).alias("cell"))
    )
    rows = cells.join(nodes.select("node", "regs", "n_shingles"), "node")
    likely = _grouped(
        rows, ["cell", "label", "node", "regs", "n_shingles"],
        lambda group: _promising(group, percent / 100), "cell long, label long, node long",
    )
    likely = stored(likely, "likely")
    wanted = nodes.join(likely.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("id"), "fp")
    sets = sets_of(wanted).dropDuplicates(["id", "fp"]).select(F.col("id").alias("node"), "shingles")
    return _grouped(
        likely.join(sets, "node"), ["cell", "label", "node", "shingles"], lambda group: _bridges(group, percent), "a long, b long"
    )


def link_sets(
    light: DataFrame, sets_of: SetsOf, percent: int, rows: int = ROWS, bands: int = BANDS, more: Sequence[Column] = ()
) -> DataFrame:
    """Components of sketched sets: (n_shingles, fp, root, banded) per distinct
    set: the smallest id reachable, and whether it shares a band with another
    set; ``more`` aggregates over its rows.
    ``light`` has id, n_shingles, fp, regs; ``sets_of(wanted)`` gives id, fp,
    shingles for rows of id and fp."""
    threshold = percent / 100
    nodes = stored(
        light.filter("n_shingles > 0 and id is not null")
        .groupBy("n_shingles", "fp")
        .agg(F.min("id").alias("node"), F.first("regs").alias("regs"), *more),
        "nodes",
    )
    # A set so small that one more element falls below the threshold matches
    # its equals only, which are one node.
    keyed = _banded(nodes.filter(f"n_shingles * {100 - percent} >= {percent}"), rows, bands)
    # Each band draws its own node to hold the others against, so a node of a
    # large group meets many of its neighbours in one round.
    drawn = F.min(F.struct(F.xxhash64("key", "node"), "node"))
    shared = keyed.groupBy("key").agg(drawn.getField("node").alias("rep"), F.count("*").alias("n")).filter("n > 1")
    banded = stored(keyed.join(shared.select("key", "rep"), "key"), "bands")
    stars = banded.filter("node != rep").select(F.least("rep", "node").alias("a"), F.greatest("rep", "node").alias("b")).distinct()
    likely = stored(_near(stars, nodes, threshold), "stars")
    links = stored(_confirm(likely, nodes, sets_of, percent), "links")
    labels = components(links)
    inner = banded.select("node").distinct().join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    inner = stored(inner, "labels")
    links = stored(_across(banded.select("node", "key"), inner, nodes, sets_of, percent), "across")
    side = lambda x: inner.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
    bridges = links.join(side("b"), "b").join(side("a"), "a").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
    merged = components(bridges).select(F.col("node").alias("label"), F.col("label").alias("root"))
    roots = inner.join(merged, "label", "left").select("node", F.coalesce("root", "label").alias("root"))
    kept = [c for c in nodes.columns if c not in ("node", "regs")]
    root = F.coalesce("root", "node").alias("root")
    return nodes.drop("regs").join(roots, "node", "left").select(*kept, root, F.col("root").isNotNull().alias("banded"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``:
    documents are linked where 100 x intersection >= percent x union of their
    shingle sets; the smallest id of a component is kept."""
    light = stored(sketches(docs, shingle), "sketches")

    def sets_of(wanted: DataFrame) -> DataFrame:
        texts = _input(docs).join(wanted.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
        return shingle_sets(texts, shingle).withColumnRenamed("doc_id", "id").join(wanted, ["id", "fp"], "left_semi")

    classes = link_sets(light.withColumnRenamed("doc_id", "id"), sets_of, percent)
    found = light.drop("regs").join(classes.drop("banded"), ["n_shingles", "fp"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return found.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
