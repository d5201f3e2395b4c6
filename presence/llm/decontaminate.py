"""Benchmark decontamination by templates.

Texts are canonicalised word by word: numbers become <NUM>, the unit after a
number <UNIT>, capitalised words inside a sentence <NAME>; other words are
lower-cased without signs at their ends. Windows of five canonical words with
at least two plain words are the templates. Benchmark windows are hashed into
a filter of fixed size (FILTER_BITS, combined with bit_or and broadcast);
documents emit only windows that pass it, and those meet the benchmark's in a
hash join. An item leaks into a document where at least 80 % of its windows
are found in one copy there and its slots agree: each value of an item's slot
stands for one value in the copy. Slots all equal make a verbatim copy, consistent
new values a re-parameterised one.

Items without a template window (under five words, or nearly all slots) are
compared whole: their canonical text must be a whole document's.

Nulls: null texts are empty and match nothing; rows with a null id are
skipped, as nothing could name them. Repeated rows count once. Empty tables
give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presence.llm.textkit import Words, hash_spans, lists, lookup, mix, per_slice, word_hashes

WINDOW = 5
LEAST_PLAIN = 2
FILTER_BITS = 1 << 23

UNITS = """% € $ £ kg g mg t lb km m cm mm mi ft in h hr hrs hour hours min mins minute minutes s sec second seconds day days
    week weeks month months year years l ml litre litres liter liters euro euros dollar dollars cent cents degrees kmh mph
    kilometres kilometers metres meters miles grams kilograms heures jours stunden tage jahre horas días años"""
NUM, UNIT, NAME = (mix(np.array([x], np.uint64))[0] for x in (1, 2, 3))

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".?!:;\"")] = True

ROW = "id long, pos int, h long, total int, slots array<long>"


def canonical(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word: canonical hash, value hash (of the word as written, for
    slots), and whether it is a slot."""
    s, e = words.cores()
    value = hash_spans(words.data, s, e)
    if not len(s):
        return value, value, np.zeros(0, bool)
    lead = words.raw[np.minimum(s, len(words.raw) - 1)]
    after = words.raw[np.minimum(s + 1, len(words.raw) - 1)]
    empty = e <= s
    number = (lead >= 48) & (lead <= 57) & ~empty
    unit = np.zeros(len(s), bool)
    known = np.unique(word_hashes(UNITS.split()))
    signs = np.flatnonzero(empty)
    whole = value.copy()
    whole[signs] = words.hash[signs]
    unit[1:] = (lookup(whole[1:], known) >= 0) & number[:-1]
    upper = (_UPPER[lead] | ((lead == 0xC3) & (after >= 0x80) & (after <= 0x9E) & (after != 0x97))) & ~empty
    opens = np.ones(len(s), bool)  # begins a sentence
    opens[1:] = _STOP[words.raw[words.ends[:-1] - 1]]
    opens[words.first[:-1][np.diff(words.first) > 0]] = True
    name = upper & ~opens & ~number
    code = np.where(number, NUM, np.where(unit, UNIT, np.where(name, NAME, whole)))
    return code, whole, number | unit | name


def windows(frame: DataFrame, id_: str, passes: np.ndarray | None) -> DataFrame:
    """One row per distinct template window of each text: place, hash, how
    many the text has, and the values of its slots (0 where plain). Texts
    without one give a row with pos -1 and the hash of the whole."""
    bits = passes

    def work(batch: pa.RecordBatch, words: Words) -> pa.RecordBatch:
        code, value, slot = canonical(words)
        h, at, first = words.windows(WINDOW, code)
        rows = len(first) - 1
        row = np.repeat(np.arange(rows), np.diff(first))
        full = np.diff(words.first)[row] >= WINDOW
        plain = np.zeros(len(at), np.int64)
        reach = np.minimum(at[:, None] + np.arange(WINDOW), max(len(code) - 1, 0)) if len(at) else np.zeros((0, WINDOW), np.int64)
        if len(at):
            plain = WINDOW - slot[reach].sum(axis=1)
        good = full & (plain >= LEAST_PLAIN)
        total = np.bincount(row[good], minlength=rows)
        # texts without a template window stand for themselves
        n = np.diff(words.first)
        alone = np.flatnonzero((total == 0) & (n > 0))
        whole = np.array([_whole(code[words.first[r] : words.first[r + 1]]) for r in alone], np.uint64)
        if bits is not None:
            good &= _passes(h, bits)
            keep = _passes(whole, bits) if len(whole) else np.zeros(0, bool)
            alone, whole = alone[keep], whole[keep]
        ids = batch.column(batch.schema.get_field_index("id")).to_numpy(zero_copy_only=False)
        pos = at[good] - words.first[row[good]]
        held = np.where(slot[reach[good]], value[reach[good]], np.uint64(0)) if good.any() else np.zeros((0, WINDOW), np.uint64)
        out_row = np.r_[row[good], alone].astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids[out_row].astype(np.int64)),
                pa.array(np.r_[pos, np.full(len(alone), -1)].astype(np.int32)),
                pa.array(np.r_[h[good], whole].astype(np.uint64).view(np.int64)),
                pa.array(np.r_[total[row[good]], np.ones(len(alone), np.int64)].astype(np.int32)),
                lists(np.r_[held.ravel(), np.zeros(0, np.uint64)].astype(np.uint64).view(np.int64), np.r_[np.full(len(pos), WINDOW), np.zeros(len(alone), np.int64)]),
            ],
            names=["id", "pos", "h", "total", "slots"],
        )

    texts = frame.select(F.col(id_).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return texts.filter("id is not null").mapInArrow(per_slice("text", work, fold=True), ROW)


def _whole(code: np.ndarray) -> int:
    """A hash of all words of a text, in their order."""
    place = np.arange(1, len(code) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    total = mix(code ^ mix(place)).sum(dtype=np.uint64)
    return int(mix(np.array([total + np.uint64(len(code))], np.uint64))[0])


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(FILTER_BITS - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


def _passes(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    a, b = _places(h)
    return (bits[a >> 3] >> (a & 7) & 1 & (bits[b >> 3] >> (b & 7))).astype(bool)


def benchmark_filter(items: DataFrame) -> np.ndarray:
    """FILTER_BITS bits as bytes; at most FILTER_BITS / 63 rows reach here,
    however large the benchmark is."""
    mask = FILTER_BITS - 1
    place = F.explode(F.array(F.col("h").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(mask))))
    words = (
        items.select(place.alias("p"))
        .groupBy(F.expr("p div 32").cast("int").alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 32 as int))")).alias("b"))
        .collect()
    )
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    for r in words:
        out[r["w"]] = r["b"]
    return out.view(np.uint8)


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_windows, n_found, kind) of every leaked item:
    kind is verbatim or reparameterised."""
    items = windows(benchmark, "item_id", None).dropDuplicates(["id", "pos", "h"])
    bits = benchmark_filter(items)
    found = windows(docs, "doc_id", bits).select(F.col("id").alias("doc_id"), F.col("pos").alias("at"), "h", F.col("slots").alias("doc_slots"))
    sides = items.select(F.col("id").alias("item_id"), "pos", "h", "total", F.col("slots").alias("item_slots"))
    met = found.join(sides, "h").filter("(pos < 0) = (at < 0)")
    pairs = F.expr("filter(arrays_zip(item_slots, doc_slots), p -> p.item_slots != 0)")
    # Copies in one document have slot values of their own, so each is judged
    # alone: by equal offsets, by offsets within half an item (words put in or
    # left out shift a copy's rest), and all places as one.
    over = Window.partitionBy("doc_id", "item_id").orderBy("offset", "pos", "at")
    new = F.coalesce((F.col("offset") - F.lag("offset").over(over) > F.col("total") / 2).cast("int"), F.lit(0))
    chained = met.withColumn("offset", F.col("at") - F.col("pos")).withColumn("new", new).withColumn("chain", F.sum("new").over(over))
    copies = chained.withColumn(
        "copy", F.explode(F.array(F.struct(F.lit(0).alias("by"), F.col("offset").cast("long").alias("k")), F.struct(F.lit(1).alias("by"), F.col("chain").alias("k")), F.struct(F.lit(2).alias("by"), F.lit(0).cast("long").alias("k"))))
    )
    # One row per (document, item, copy, window) before the last count: a
    # window that a copy repeats is found once.
    per_window = copies.groupBy("doc_id", "item_id", "copy", "pos").agg(
        F.max("total").alias("total"), F.min(F.struct(F.expr("aggregate(arrays_zip(item_slots, doc_slots), 0, (n, p) -> n + int(p.item_slots != p.doc_slots))").alias("n"), pairs.alias("p"))).alias("best")
    )
    per_copy = per_window.groupBy("doc_id", "item_id", "copy").agg(
        F.max("total").alias("n_windows"),
        F.count("*").alias("n_found"),
        F.sum("best.n").alias("n_changed"),
        F.flatten(F.collect_set("best.p")).alias("slots"),  # at most the item's own windows
    )
    distinct = F.array_distinct("slots")
    one_each = F.size(distinct) == F.size(F.array_distinct(F.transform(distinct, lambda p: p["item_slots"])))
    # All slots of one kind with one value each way: a re-parameterised copy.
    passed = per_copy.filter((100 * F.col("n_found") >= percent * F.col("n_windows")) & ((F.col("n_changed") == 0) | one_each))
    best = passed.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_changed") == 0).alias("verbatim"), "n_found", "n_windows")).alias("best"))
    return best.select(
        "doc_id",
        "item_id",
        F.col("best.n_windows").cast("long").alias("n_windows"),
        F.col("best.n_found").cast("long").alias("n_found"),
        F.when(F.col("best.verbatim"), "verbatim").otherwise("reparameterised").alias("kind"),
    )
