"""Duplicate paragraphs across documents.

A paragraph is a line of at least SHINGLE words. Lines are sketched over word
shingles, banded for high recall (three registers a band, BANDS bands: a pair
of similarity 0.8 shares none with probability 3e-3), joined in their bands,
verified by exact Jaccard and clustered by components; the first line of a
component stays. Sets of under four shingles reach 0.8 only with their equals
and are compared whole. Shorter lines have no shingle and are left alone
unless they stand in a passage: headings and list marks repeat by nature.

A passage pasted into other text makes no similar line, and its line breaks
may differ. Of the runs of RUN words, whatever lines they are in, those that
are the smallest by hash of some REACH in a row are anchors: a passage of RUN
+ REACH - 1 = LEAST_RUN words has one at the same words wherever it stands.
Each document that holds an anchor is compared with the smallest id that
does, word by word to either side as far as the next anchor can be; both rows
carry their words' hashes (16 bits: an end is one word too far once in 65,536
times), so one pass finds the common run. Runs that meet in a document are
one passage, kept from LEAST_RUN words on. The smallest id keeps its copy.

All scans look for what is wanted by fixed-size filters of hashes, which may
let more pass but never less; exact joins follow. No text is shuffled to find
spans, and no group of holders is gathered: they meet one small row each.

Nulls: null texts are empty; rows with a null id are left alone and give no
rows. Rows of one id are one document, but each text is cut by its own spans.
Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presence.llm.components import components
from presence.llm.hyperminhash import _prints, fixed_binary, link_sets, registers, unique_rows
from presence.llm.textkit import Words, hash_filter, hash_spans, in_filter, lists, mix, per_slice, stored

SHINGLE = 5
REGISTER_BITS = 5
BAND_ROWS, BANDS = 3, 8
RUN, REACH = 8, 23
LEAST_RUN = RUN + REACH - 1
SIDE = REACH - 1

SPANS = (
    "doc_id long, kind string, first_word long, n_words long, byte_from long, byte_to long, cluster long, removed boolean, text_hash long"
)
PLACES = "doc_id long, text_hash long, first_word long, n_words long, byte_from long, byte_to long"
CONTEXT = "h long, doc_id long, text_hash long, word long, byte_from long, byte_to long, codes binary, steps binary"
MATCH = "doc_id long, text_hash long, removed boolean, first long, last long, byte_from long, byte_to long, h long"
PASSAGE = PLACES + ", removed boolean, anchors array<long>"


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False).astype(np.int64)


def _text_hashes(words: Words) -> np.ndarray:
    """Of each row's text, as Spark's ``xxhash64`` gives it."""
    whole, at = words.raw.tobytes(), words.offsets.tolist()
    return np.array([xxhash.xxh64_intdigest(whole[a:b], 42) for a, b in zip(at[:-1], at[1:], strict=True)], np.uint64).view(np.int64)


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


# -- lines --------------------------------------------------------------------


def _lines(words: Words) -> np.ndarray:
    """The first word of each line that has one, and the end."""
    breaks = np.searchsorted(np.flatnonzero(words.data == 10), words.starts)
    lead = np.ones(len(words.starts), bool)
    lead[1:] = breaks[1:] != breaks[:-1]
    lead[words.first[:-1][np.diff(words.first) > 0]] = True
    return np.r_[np.flatnonzero(lead), len(words.starts)]


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The places from each begin to its end, one range after the other."""
    size = end - begin
    return np.arange(size.sum()) + np.repeat(begin - np.r_[0, np.cumsum(size)[:-1]], size) if len(size) else np.zeros(0, np.int64)


def _uid(ids: np.ndarray, number: np.ndarray) -> np.ndarray:
    """63 bits that name a place in a document."""
    return (mix(mix(ids.view(np.uint64)) + number.astype(np.uint64)) >> np.uint64(1)).view(np.int64)


def _print_hash(fp: pa.Array) -> np.ndarray:
    """64 bits of each print, for filters."""
    return np.frombuffer(b"".join(fp.to_pylist()), np.uint64).reshape(-1, 2)[:, 1].copy()  # none is null: lines have words


def _compared_lines(docs: DataFrame, what: str, wanted=None) -> DataFrame:
    """Lines of SHINGLE words: their sketches, the full ``sets`` of lines whose
    id is wanted, or the ``places`` of lines whose set is; ``wanted`` is a
    broadcast filter."""

    def work(batch: pa.RecordBatch, words: Words) -> pa.RecordBatch:
        edge = _lines(words)
        some = np.flatnonzero(np.diff(edge) >= SHINGLE)
        begin, end = edge[some], edge[some + 1]
        row = np.searchsorted(words.first, begin, "right") - 1
        ids = _ids(batch)[row]
        number = begin - words.first[row]
        uid = _uid(ids, number)
        if what == "sets":
            keep = in_filter(uid.view(np.uint64), wanted.value)
            begin, end, uid = begin[keep], end[keep], uid[keep]
        # windows over these lines only, as if each were a row
        pick = _ranges(begin, end)
        view = Words.__new__(Words)
        view.first, view._hash = np.r_[0, np.cumsum(end - begin)], np.zeros(0, np.uint64)
        if len(pick) and what == "sets":  # few lines: only their bytes are hashed
            from_, to = words.starts[begin], words.ends[end - 1]
            moved = np.repeat(from_ - np.r_[0, np.cumsum(to - from_)[:-1]], end - begin)
            view._hash = hash_spans(words.data[_ranges(from_, to)], words.starts[pick] - moved, words.ends[pick] - moved)
        elif len(pick):
            view._hash = words.hash[pick]
        values, _, first = view.windows(SHINGLE)
        values, counts = unique_rows(values, first)
        fp = _prints(values, counts)
        if what == "sets":
            return _batch({"id": uid, "fp": fp, "shingles": lists(values.view(np.int64), counts)})
        if what == "sketches":
            regs = registers(values, counts, REGISTER_BITS)[:, : BAND_ROWS * BANDS]
            return _batch({"id": uid, "doc_id": ids, "fp": fp, "n_shingles": counts, "regs": fixed_binary(regs)})
        keep = np.flatnonzero(in_filter(_print_hash(fp), wanted.value)) if len(fp) else np.zeros(0, np.int64)
        begin, end, row, base = begin[keep], end[keep], row[keep], words.offsets[row[keep]]
        return _batch(
            {
                "fp": fp.take(pa.array(keep)), "n_shingles": counts[keep], "doc_id": ids[keep],
                "text_hash": _text_hashes(words)[row] if len(row) else np.zeros(0, np.int64), "first_word": number[keep], "n_words": end - begin,
                "byte_from": words.starts[begin] - base, "byte_to": words.ends[end - 1] - base,
            }
        )

    schema = {
        "sketches": "id long, doc_id long, fp binary, n_shingles long, regs binary",
        "sets": "id long, fp binary, shingles array<long>",
        "places": "fp binary, n_shingles long, " + PLACES,
    }[what]
    return _texts(docs).mapInArrow(per_slice("text", work), schema)


def near_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """SPANS rows of lines that have a near duplicate in another document."""
    spark = docs.sparkSession

    def sets_of(wanted: DataFrame) -> DataFrame:
        held = hash_filter(wanted.select(F.col("id").alias("h")))
        return _compared_lines(docs, "sets", spark.sparkContext.broadcast(held)).join(wanted, ["id", "fp"], "left_semi")

    ends = F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")
    classes = link_sets(_compared_lines(docs, "sketches"), sets_of, percent, BAND_ROWS, BANDS, more=ends)
    # a set in one document and without a band in common is no duplicate
    classes = stored(classes.filter("lo != hi or banded"), "classes")
    groups = classes.groupBy("root").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo != hi").select("root")
    shared = stored(classes.join(groups, "root").select("n_shingles", "fp", "root"), "shared")

    def hashes(batches):
        for batch in batches:
            if batch.num_rows:
                yield _batch({"h": _print_hash(batch.column(0)).view(np.int64)})

    held = hash_filter(shared.select("fp").mapInArrow(hashes, "h long"))
    lines = stored(_compared_lines(docs, "places", spark.sparkContext.broadcast(held)).join(shared, ["n_shingles", "fp"]), "lines")
    first = lines.groupBy("root").agg(F.min(F.struct("doc_id", "first_word")).alias("keep"))
    return lines.join(first, "root").select(
        "doc_id", F.lit("line").alias("kind"), "first_word", "n_words", "byte_from", "byte_to",
        F.col("root").alias("cluster"), (F.struct("doc_id", "first_word") != F.col("keep")).alias("removed"), "text_hash",
    )


# -- passages -----------------------------------------------------------------

def _runs(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """A hash of the RUN words from each word on, and how many words its row
    has from there; hashes mean nothing where fewer than RUN are left."""
    h, n = words.hash.copy(), 1
    while n < RUN:
        h[:-n] = mix(h[:-n] * np.uint64(0xFF51AFD7ED558CCD) ^ (h[n:] + np.uint64(n))) if n < len(h) else h[:-n]
        n *= 2
    return h, words.first[words.row + 1] - np.arange(len(h))


def _anchors(words: Words, h: np.ndarray, left: np.ndarray) -> np.ndarray:
    """First words of the runs that are the smallest of some REACH runs in a
    row (of all, in shorter texts); the leftmost of equal ones."""
    row = words.row
    # rows stand REACH largest values apart, so none is another's smallest
    spread = np.arange(len(h)) + row * REACH
    apart = np.full(len(h) + (len(words.first) - 1) * REACH, np.uint64(0xFFFFFFFFFFFFFFFF))
    whole = left >= RUN
    apart[spread[whole]] = h[whole]
    low, n = apart.copy(), 1
    while n < REACH:
        step = min(n, REACH - n)
        low[:-step] = np.minimum(low[:-step], low[step:])
        n += step
    begin = whole & ((left >= RUN + REACH - 1) | (np.arange(len(h)) == words.first[row]))
    moved = begin.copy()
    # the smallest stays where it is until it is passed or undercut
    at = spread[1:]
    moved[1:] &= (row[1:] != row[:-1]) | (low[at] != low[at - 1]) | (apart[at - 1] == low[at - 1])
    begin = np.flatnonzero(moved)
    if not len(begin):
        return begin
    view = np.lib.stride_tricks.sliding_window_view(apart, REACH)
    return np.unique(begin + view[spread[begin]].argmin(axis=1))


def _own_key(h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Names an anchor in one document."""
    return mix(h + mix(ids.view(np.uint64)))


def _holder_key(ids: np.ndarray) -> np.ndarray:
    return mix(ids.view(np.uint64))


def anchors(docs: DataFrame) -> DataFrame:
    """(h, doc_id): every anchor of every document."""

    def work(batch: pa.RecordBatch, words: Words) -> pa.RecordBatch:
        h, left = _runs(words)
        at = _anchors(words, h, left) if len(h) else np.zeros(0, np.int64)
        row = words.row[at]
        return _batch({"h": h[at].view(np.int64), "doc_id": _ids(batch)[row]})

    return _texts(docs).mapInArrow(per_slice("text", work), "h long, doc_id long")


def _bytes_of(rows: np.ndarray) -> pa.Array:
    """Rows of whole numbers, two bytes each where all of a row fit, else four."""
    wide = (rows > 0xFFFF).any(axis=1)
    parts, order = [], []
    for mask, kind in ((~wide, "<u2"), (wide, "<u4")):
        some = np.ascontiguousarray(rows[mask].astype(kind))
        if len(some):
            offsets = np.arange(len(some) + 1, dtype=np.int32) * np.int32(some[0].nbytes)
            parts.append(pa.BinaryArray.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(some)]))
            order.append(np.flatnonzero(mask))
    if not parts:
        return pa.array([], pa.binary())
    return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(order))))


def _numbers_of(col: pa.Array) -> np.ndarray:
    """What ``_bytes_of`` wrote."""
    out = np.empty((len(col), 2 * SIDE), np.int64)
    held = col.to_pylist()
    sizes = np.array([len(x) for x in held])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        out[at] = np.frombuffer(b"".join(held[i] for i in at), f"<u{size // (2 * SIDE)}").reshape(-1, 2 * SIDE)
    return out


def contexts(docs: DataFrame, wanted, holders=None) -> DataFrame:
    """CONTEXT rows of anchors that pass a broadcast filter, of their hash or
    (with ``holders``, a filter of the documents to read) of hash and document: up to SIDE words to the left (nearest first)
    and to the right as 16-bit codes, 0 beyond the text, and as byte steps
    from the anchor's first byte to a left word's, and to a right word's end."""

    def work(batch: pa.RecordBatch, words: Words) -> pa.RecordBatch:
        h, left = _runs(words)
        at = _anchors(words, h, left) if len(h) else np.zeros(0, np.int64)
        ids = _ids(batch)
        row = words.row[at]
        key = h[at] if holders is None else _own_key(h[at], ids[row])
        keep = in_filter(key, wanted.value)
        at, row = at[keep], row[keep]
        j = np.arange(SIDE)
        place = np.concatenate([at[:, None] - 1 - j, at[:, None] + RUN + j], axis=1)
        some = (place >= words.first[row][:, None]) & (place < words.first[row + 1][:, None])
        place = np.where(some, place, 0)
        code = (words.hash >> np.uint64(48)).astype(np.int64) if len(h) else np.zeros(1, np.int64)
        start = words.starts[at][:, None] if len(at) else np.zeros((0, 1), np.int64)
        steps = np.concatenate([start - words.starts[place[:, :SIDE]], words.ends[place[:, SIDE:]] - start], axis=1) if len(at) else np.zeros((0, 2 * SIDE), np.int64)
        base = words.offsets[row]
        return _batch(
            {
                "h": h[at].view(np.int64), "doc_id": ids[row], "text_hash": _text_hashes(words)[row] if len(row) else np.zeros(0, np.int64),
                "word": at - words.first[row],
                "byte_from": words.starts[at] - base, "byte_to": words.ends[at + RUN - 1] - base,
                "codes": _bytes_of(np.where(some, np.maximum(code[place], 1), 0)), "steps": _bytes_of(np.where(some, steps, 0)),
            }
        )

    run = per_slice("text", work)

    def of_holders(batches):
        return run(b.filter(pa.array(in_filter(_holder_key(_ids(b)), holders.value))) for b in batches)

    return _texts(docs).mapInArrow(run if holders is None else of_holders, CONTEXT)


def _common(batches):
    """MATCH rows of both sides: the words that a document and the first
    holder of an anchor have in common around it."""
    for batch in batches:
        if not batch.num_rows:
            continue
        of = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
        number = lambda name: of(name).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: B023, E731
        a, b = _numbers_of(of("codes")), _numbers_of(of("first_codes"))
        same = (a == b) & (a > 0)
        left, right = (np.cumprod(x, axis=1).sum(axis=1) for x in (same[:, :SIDE], same[:, SIDE:]))
        at = np.arange(len(a))
        out = []
        for side in ("", "first_"):
            steps, from_, word = _numbers_of(of(f"{side}steps")), number(f"{side}byte_from"), number(f"{side}word")
            out.append(
                [
                    number(f"{side}doc_id"), number(f"{side}text_hash"), np.full(len(a), side == ""), word - left, word + RUN + right,
                    from_ - np.where(left, steps[at, left - 1], 0),
                    np.where(right, from_ + steps[at, SIDE + right - 1], number(f"{side}byte_to")), number("h"),
                ]
            )
        names = [x.split()[0] for x in MATCH.split(", ")]
        yield _batch(dict(zip(names, out[0], strict=True)))
        # one row for all who share the same words with the first holder
        _, lead = np.unique(np.stack([out[1][7], out[1][3], out[1][4]]), axis=1, return_index=True)
        yield _batch({n: x[lead] for n, x in zip(names, out[1], strict=True)})


def _merged(batches):
    """PASSAGE rows from MATCH rows that come document by document, by place."""

    def numbers(held: list[pa.RecordBatch]) -> list[np.ndarray]:
        whole = pa.Table.from_batches(held)
        return [c.to_numpy() for c in whole.columns]

    def runs(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Where a run begins: no row before it in its document reaches it."""
        room = np.int64(1) << np.int64(32)
        reach = np.maximum.accumulate(last + doc * room)
        return np.flatnonzero(np.r_[True, first[1:] + doc[1:] * room > reach[:-1]])

    def merged(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, texts, removed, first, last, from_, to, h = numbers(held)
        doc = np.cumsum(np.r_[0, (ids[1:] != ids[:-1]) | (texts[1:] != texts[:-1])])
        lead = runs(doc, first, last)
        long = np.maximum.reduceat(last, lead) - first[lead] >= LEAST_RUN
        keep = np.repeat(long, np.diff(np.r_[lead, len(ids)]))
        out: list[list[np.ndarray]] = []
        for gone in (True, False):
            some = keep & (removed == gone)
            if not some.any():
                continue
            own = [x[some] for x in (ids, texts, first, last, from_, to, h)]
            lead = runs(doc[some], own[2], own[3])
            end = np.r_[lead[1:], len(own[0])]
            last_ = np.maximum.reduceat(own[3], lead)
            places = [own[0][lead], own[1][lead], own[2][lead], last_ - own[2][lead], np.minimum.reduceat(own[4], lead), np.maximum.reduceat(own[5], lead)]
            out.append([*places, np.full(len(lead), gone), end - lead, own[6]])
        if not out:
            out = [[np.zeros(0, np.int64)] * 6 + [np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)]]
        *columns, counts, h = (np.concatenate(x) for x in zip(*out, strict=True))
        names = [x.split()[0] for x in PASSAGE.split(", ")]
        return _batch(dict(zip(names, [*columns, lists(h, counts)], strict=True)))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy()
        lead = int(np.searchsorted(ids, ids[-1]))
        if lead:  # the last document may go on
            yield merged([*held, batch.slice(0, lead)])
            held = []
        elif held and held[-1].column(0)[-1].as_py() != ids[0]:
            yield merged(held)
            held = []
        held.append(batch.slice(lead))
    if held:
        yield merged(held)


def passages(docs: DataFrame, clustered: bool = True) -> DataFrame:
    """SPANS rows of passages that stand in two or more documents; without
    ``clustered`` the cluster is the passage itself."""
    spark = docs.sparkSession
    shared = anchors(docs).groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("hi"))
    shared = stored(shared.filter("doc_id != hi").drop("hi"), "anchors")

    def owned(batches):
        for batch in batches:
            h, ids = (batch.column(i).to_numpy() for i in range(2))
            yield _batch({"h": _own_key(h.view(np.uint64), ids).view(np.int64)})

    def holding(batches):
        for batch in batches:
            yield _batch({"h": _holder_key(batch.column(0).to_numpy()).view(np.int64)})

    places = spark.sparkContext.broadcast(hash_filter(shared.mapInArrow(owned, "h long")))
    holders = spark.sparkContext.broadcast(hash_filter(shared.select("doc_id").distinct().mapInArrow(holding, "h long")))
    own = contexts(docs, places, holders).join(shared, ["h", "doc_id"], "left_semi")
    rest = [c for c in own.columns if c != "h"]
    least = own.groupBy("h").agg(F.min(F.struct("word", *[c for c in rest if c != "word"])).alias("x"))
    first = stored(least.select("h", *[F.col(f"x.{c}").alias(f"first_{c}") for c in rest]), "first")
    known = spark.sparkContext.broadcast(hash_filter(shared.select("h")))
    met = contexts(docs, known).join(first, "h").filter("doc_id != first_doc_id")
    dealt = met.mapInArrow(_common, MATCH).repartition("doc_id").sortWithinPartitions("doc_id", "text_hash", "first")
    found = stored(dealt.mapInArrow(_merged, PASSAGE).withColumn("span", F.xxhash64("doc_id", "text_hash", "first_word", "removed")), "passages")
    spans = found.drop("anchors").withColumn("cluster", F.col("span"))
    if clustered:
        held = found.select("span", F.explode("anchors").alias("h"))
        least = held.groupBy("h").agg(F.min("span").alias("rep"))
        links = held.join(least, "h").filter("rep != span").select(F.col("rep").alias("a"), F.col("span").alias("b")).distinct()
        labels = components(links)
        spans = spans.drop("cluster").join(labels, F.col("span") == F.col("node"), "left").withColumn("cluster", F.coalesce("label", "span"))
    return spans.select(
        "doc_id", F.lit("passage").alias("kind"), "first_word", "n_words", "byte_from", "byte_to", "cluster", "removed", "text_hash"
    )


def duplicate_spans(docs: DataFrame, clustered: bool = True) -> DataFrame:
    """Near-duplicate lines and pasted passages, kept and removed."""
    return near_lines(docs).unionByName(passages(docs, clustered))


def cut_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` (columns unchanged) with the removed spans cut from ``text``;
    ``n_chars`` follows. A cut leaves one space or line break, whichever
    followed; documents left without a word are dropped."""
    gone = (
        spans.filter("removed")
        .groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
        .agg(F.array_sort(F.collect_list(F.struct("byte_from", "byte_to"))).alias("__spans"))
    )
    here = (F.col("doc_id").cast("long") == F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__hash"))
    held = docs.join(gone, here, "left").select(*docs.columns, "__spans")

    def cut(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            spans_ = batch.column(batch.schema.get_field_index("__spans"))
            out, touched = texts.to_pylist(), np.flatnonzero(spans_.is_valid().to_numpy(zero_copy_only=False))
            for i in touched.tolist():
                raw, at, kept = (out[i] or "").encode(), 0, []
                for c in spans_[i].as_py():
                    if c["byte_to"] > at:
                        kept.append(raw[at : max(at, c["byte_from"])])
                        at = c["byte_to"]
                out[i] = b" ".join(k.strip(b" ") for k in [*kept, raw[at:]]).decode("utf-8", "ignore").strip(" \n")
            yield pa.RecordBatch.from_arrays(
                [pa.array(out, pa.string()) if n == "text" else batch.column(i) for i, n in enumerate(batch.schema.names) if n != "__spans"]
                + [spans_.is_valid()],
                names=[*[n for n in batch.schema.names if n != "__spans"], "__cut"],
            )

    schema = docs.select(*docs.columns, F.lit(True).alias("__cut")).schema
    out = held.mapInArrow(cut, schema).filter(~F.col("__cut") | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("__cut"), length).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
