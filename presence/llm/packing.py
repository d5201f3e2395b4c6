"""Packing of tokenised documents by minimum bin slack.

Token lengths are at most ``size``, so the whole corpus is a histogram of
``size`` counts. The fullest feasible combination for a bin is found on the
histogram: the longest piece left is placed, then a bitset subset-sum over
the lengths available (with their counts) finds the fullest filling of the
rest. The combination is removed as often as the counts allow - the bins one
by one would choose it again as long as its pieces last - so the plan has at
most one line per length. Pieces are then ranked within their length, in
cells whose counts are summed first, and the plan's lines tell each rank its
sequence and place: no group of equal lengths meets in one task.

Tokens come from the given tokenizer file and are never trained. Its pieces
are found on code point arrays, and distinct pieces are encoded once per
batch by the same byte-pair merges; texts with apostrophes, NULs, the signs
of special tokens or letters whose lower case depends on context go through
the tokenizer itself. tests/llm hold both against each other.

Nulls: a null text is empty, its document is the end id alone; a null id is
kept as null. Repeated rows are packed each. An empty table gives no rows.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presence.llm.textkit import column, hash_spans, slices, stored

SIZE = 2048
CELL_ROWS = 20_000
TEXT_SLICE = 4 << 20

LETTER, NUMBER, BLANK = 1, 2, 3

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _merger(path: str):
    """The tokenizer's merges as byte ranks, a NUL ending each piece, and the
    ids that the ranks stand for."""
    import tiktoken

    model = json.load(open(path))["model"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    mark = model["end_of_word_suffix"]

    def as_bytes(token: str) -> bytes:
        ends = token.endswith(mark)
        return bytes(byte_of[c] for c in (token[: -len(mark)] if ends else token)) + b"\0" * ends

    ranks = {bytes([b]): b for b in range(256)}
    ids = [0] * 256
    for c, b in byte_of.items():
        ids[b] = model["vocab"][c]
    for c, b in byte_of.items():
        if b:
            ranks[bytes([b, 0])] = len(ids)
            ids.append(model["vocab"][c + mark])
    for merge in model["merges"]:
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        if (joined := as_bytes(a) + as_bytes(b)) not in ranks:
            ranks[joined] = len(ids)
            ids.append(model["vocab"][a + b])
    coder = tiktoken.Encoding("pieces", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
    return coder, np.array(ids, np.uint32)


@cache
def _classes() -> np.ndarray:
    """Letter, number, blank or other, by code point."""
    import regex

    every = "".join(chr(i) if not 0xD800 <= i < 0xE000 else "." for i in range(0x110000))
    out = np.zeros(0x110000, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK)):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def _encode_group(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of texts that need no special care."""
    joined = "\n".join(texts)
    if not joined.isascii():
        joined = "\n".join(texts := [unicodedata.normalize("NFC", t) for t in texts])
    lower = joined.lower()
    code = np.frombuffer(lower.encode("utf-32-le"), np.uint32)
    kind = _classes()[code]
    some = kind != BLANK
    begin = some.copy()
    begin[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    starts = np.flatnonzero(begin)
    finish = some.copy()
    finish[:-1] &= begin[1:] | ~some[1:]
    ends = np.flatnonzero(finish) + 1
    hashes = hash_spans(code.astype(np.uint32), starts, ends)
    _, lead, which = np.unique(hashes, return_index=True, return_inverse=True)
    pieces = [lower[s:e] for s, e in zip(starts[lead].tolist(), ends[lead].tolist(), strict=True)]
    coder, ids = _merger(path)
    flat = np.array(coder.encode_ordinary("\0".join(pieces) + "\0" if pieces else ""), np.int64)
    # the last token of a piece is the one whose bytes end in the mark
    stop = np.flatnonzero(_closing(path)[flat]) + 1
    begin_of = np.r_[0, stop[:-1]] if len(stop) else stop
    size = (stop - begin_of)[which]
    out_first = np.r_[0, np.cumsum(size)]
    at = np.arange(out_first[-1]) + np.repeat(begin_of[which] - out_first[:-1], size)
    tokens = ids[flat[at]]
    lengths = np.array([len(t.lower()) for t in texts], np.int64) + 1
    bounds = np.searchsorted(starts, np.r_[0, np.cumsum(lengths)])
    return np.split(tokens, out_first[bounds[1:-1]])


@cache
def _closing(path: str) -> np.ndarray:
    coder, ids = _merger(path)
    out = np.zeros(len(ids), bool)
    for token, rank in coder._mergeable_ranks.items():
        out[rank] = token.endswith(b"\0")
    return out


def _special(text: str) -> bool:
    return "'" in text or "\0" in text or "<|" in text or "Σ" in text or "İ" in text


def token_ids(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of each text, as the tokenizer gives them without special tokens."""
    out: list[np.ndarray | None] = [None] * len(texts)
    plain = [i for i, t in enumerate(texts) if not _special(t)]
    for i, ids in zip(plain, _encode_group([texts[i] for i in plain], path) if plain else [], strict=True):
        out[i] = ids
    for i, text in enumerate(texts):
        if out[i] is None:
            out[i] = np.array(_tokenizer(path).encode(text, add_special_tokens=False).ids, np.uint32)
    return out


def token_pieces(docs: DataFrame, path: str, size: int = SIZE, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            col = column(batch, "text")
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            for a, b in slices(col, TEXT_SLICE):
                rows = []
                for i, tokens in enumerate(token_ids(col.slice(a, b - a).to_pylist(), path)):
                    tokens = np.append(tokens.astype("<u4"), np.array([end_id], "<u4"))
                    for k, s in enumerate(range(0, len(tokens), size)):
                        part = tokens[s : s + size]
                        rows.append((ids[a + i], k, s, len(part), zlib.crc32(part.tobytes())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, PIECES)


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, longest first, whose sum is the largest of at most ``room``
    that the counts allow. Bit s of ``reach[i]`` says that sum s is made of
    the first i bundles of pieces; bundles of 1, 2, 4, ... pieces of one
    length make any number of them. Bundles join from the longest length down
    and the first full sum ends the search, so that short pieces are left to
    fill later bins."""
    bundles = []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left > 0:
            bundles.append((length, min(take, left)))
            left -= take
            take *= 2
    reach, full = [1], (1 << (room + 1)) - 1
    for length, n in bundles:
        reach.append((reach[-1] | (reach[-1] << (length * n))) & full)
        if reach[-1] >> room & 1:
            break
    goal, out = reach[-1].bit_length() - 1, []
    for i in range(len(reach) - 1, 0, -1):
        if not reach[i - 1] >> goal & 1:
            length, n = bundles[i - 1]
            out += [length] * n
            goal -= length * n
    return sorted(out, reverse=True)


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[list[int], int]]:
    """(lengths of a bin, longest first; how many such bins)."""
    left = {k: v for k, v in histogram.items() if v > 0}
    lines = []
    while left:
        longest = max(left)
        left[longest] -= 1
        rest = {k: v for k, v in left.items() if v}
        bin_ = [longest, *fullest(rest, size - longest)]
        left[longest] += 1
        need: dict[int, int] = {}
        for x in bin_:
            need[x] = need.get(x, 0) + 1
        times = min(left[x] // n for x, n in need.items())
        lines.append((bin_, times))
        for x, n in need.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return lines


def places(lines: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, pieces per bin, bins, first sequence, offset of
    the first): where the ranks of a length go, run by run."""
    ranks: dict[int, int] = {}
    rows, sequence = [], 0
    for bin_, times in lines:
        at, i = 0, 0
        while i < len(bin_):
            n = bin_.count(bin_[i])
            rows.append((bin_[i], ranks.get(bin_[i], 0), n, times, sequence, at))
            ranks[bin_[i]] = ranks.get(bin_[i], 0) + n * times
            at += bin_[i] * n
            i += n
        sequence += times
    return rows


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to pieces (``length`` of 1 to ``size``)."""
    spark = pieces.sparkSession
    pieces = stored(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    cells = max(1, -(-sum(counts.values()) // CELL_ROWS))
    runs = spark.createDataFrame(
        places(plan(counts, size)), "length long, run_rank long, per_bin long, bins long, first_sequence long, run_offset long"
    )
    # 64-bit hash of the row's own values: the same whenever it is computed.
    cell = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(cells))
    celled = pieces.withColumn("cell", cell)
    before = (
        celled.groupBy("length", "cell")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("cell")) - F.col("n"))
        .drop("n")
    )
    order = Window.partitionBy("cell", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        celled.withColumn("at", F.row_number().over(order) - 1)
        .join(before, ["cell", "length"])
        .withColumn("rank", F.col("at") + F.col("before"))
    )
    # A length has few runs; they travel as one sorted array of at most `size`.
    per_length = runs.groupBy("length").agg(
        F.array_sort(F.collect_list(F.struct("run_rank", "per_bin", "bins", "first_sequence", "run_offset"))).alias("runs")
    )
    run = F.expr("element_at(filter(runs, r -> r.run_rank <= rank), -1)")
    out = ranked.join(F.broadcast(per_length), "length").withColumn("run", run)
    inside = F.col("rank") - F.col("run.run_rank")
    return out.select(
        *pieces.columns,
        (F.col("run.first_sequence") + F.floor(inside / F.col("run.per_bin"))).cast("long").alias("sequence_id"),
        (F.col("run.run_offset") + (inside % F.col("run.per_bin")) * F.col("length")).cast("long").alias("offset"),
    )
