"""Collocations from FM-indexes over word ids.

Texts are folded (A-Z), split into pieces at punctuation and line ends and
into words. A task gathers the pieces of a language into shards of about
SHARD words; a shard's dictionary numbers its distinct words, and its text is
the numbers with a break, the smallest symbol, between pieces.

A shard's suffixes are sorted to the depth of the longest phrase only. Its
Burrows-Wheeler transform gives each suffix the word before it, and the stable
order of the transform (the LF mapping) lays the suffixes that one word
extends to the left side by side: the runs of equal (word, interval) are the
intervals of all phrases one word longer, with their counts. The interval in
the index of the reversed text moves in step (the counts of smaller symbols
are added to its start), so the transform there gives the words to the right
of the same occurrences. Phrases are therefore enumerated level by level:
every phrase is its core's interval, extended left and right at once.

Shards hand on one row per phrase and level; Spark sums them. A phrase that
occurs ``least`` times is made of phrases that do, so each level only counts
phrases whose two parts, all but the last and all but the first word, were
kept: a fixed-size filter of hashes settles most in the shard (it may let
others pass, never the reverse), and sums below ``least`` go.

Words are 64-bit hashes between shards. Each shard hands its words on with
their hashes, and two words of one hash would be seen there: the seed is then
changed and the count begun again. Sums are exact; scores are whole-number
divisions of decimals.

Nulls: null texts are empty, null languages ``und``; ids do not matter, and
repeated rows count each time. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presence.llm.textkit import LOWER, column, hash_filter, in_filter, mix, raw, slices, stored

SHARD = 1 << 18
ROWS = 1 << 16
SALTS = 32
LEAST, DEPTH, TOP, SHARE = 10, 3, 2000, 50

# What ends a piece, and what stands between words.
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP = np.zeros(256, bool)
GAP[[0x20, 0x09]] = True
PIECE_PATTERN, GAP_PATTERN = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]+"


# -- shards -------------------------------------------------------------------


def _cut(col: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of the rows, exactly numbered, and the places in their order
    before which a piece ends."""
    data, offsets = raw(col)
    data = LOWER[data]
    ends = ENDS[data]
    inside = ~(ends | GAP[data])
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]  # words do not cross rows
    begin[edge] = inside[edge]
    end[edge - 1] = inside[edge - 1]
    starts, stops = np.flatnonzero(begin), np.flatnonzero(end) + 1
    sizes = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(stops - starts, out=sizes[1:])
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(sizes), pa.py_buffer(np.ascontiguousarray(data[inside])))
    breaks = np.searchsorted(starts, np.sort(np.r_[np.flatnonzero(ends), offsets[1:]]))
    return words.dictionary_encode(), breaks[np.r_[True, breaks[1:] != breaks[:-1]]]


class Shard:
    """The distinct words of some pieces, their hashes and counts, and the
    text as word numbers (1 and up) with the break 0 between pieces."""

    def __init__(self, parts: list[tuple[pa.DictionaryArray, np.ndarray]], seed: int):
        words = pa.chunked_array([d for d, _ in parts]).unify_dictionaries()
        self.words = words.chunk(0).dictionary
        self.codes = np.concatenate([c.indices.to_numpy() for c in words.chunks]).astype(np.int64)
        self.counts = np.bincount(self.codes, minlength=len(self.words))
        before = np.cumsum([0, *[len(d) for d, _ in parts]])
        self.breaks = np.concatenate([[0], *[b + n for (_, b), n in zip(parts, before[:-1], strict=True)], before[-1:]])
        self.hash = np.array([xxhash.xxh64_intdigest(w, seed) for w in self.words.cast(pa.binary()).to_pylist()], np.uint64)

    def text(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The text of the kept words, numbered anew, with breaks in place of
        the others; and the hashes by number."""
        number = np.where(keep, np.cumsum(keep), 0)
        breaks = self.breaks[np.r_[True, self.breaks[1:] != self.breaks[:-1]]]
        return np.insert(number[self.codes], breaks, 0), np.r_[np.zeros(1, np.uint64), self.hash[keep]]


def _shards(batches, seed: int, size: int):
    """(language, Shard) of a task's rows, SHARD words or one slice each."""
    parts: dict[str, list] = {}
    counts: dict[str, int] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        langs = pc.fill_null(batch.column(0).cast(pa.string()), "und")
        texts = column(batch, "text")
        for lang in langs.unique().to_pylist():
            own = texts.filter(pc.equal(langs, lang))
            for a, b in slices(own):
                words, breaks = _cut(own.slice(a, b - a))
                parts.setdefault(lang, []).append((words, breaks))
                counts[lang] = counts.get(lang, 0) + len(words)
                if counts[lang] >= size:
                    yield lang, Shard(parts.pop(lang), seed)
                    counts[lang] = 0
                    pa.default_memory_pool().release_unused()  # workers share an executor's memory
    for lang, held in parts.items():
        if counts[lang]:
            yield lang, Shard(held, seed)


# -- the index ----------------------------------------------------------------


class FMIndex:
    """A depth-limited FM-index of a text of numbers that starts and ends with
    the break 0: suffixes in the order of their first ``depth`` symbols, read
    as a circle, with the symbol before each and the LF order. Phrases of up
    to ``depth`` symbols have intervals; extensions count one more."""

    def __init__(self, text: np.ndarray, depth: int):
        self.size, self.text = len(text), text
        width, self.bits = int(text.max(initial=0)).bit_length(), len(text).bit_length()
        if depth * width + self.bits <= 63:
            key = text
            for j in range(1, depth):
                key = (key << width) | np.roll(text, -j)
            self.suffix = self._ordered(key)
        else:  # passes from the last symbols to the first
            self.suffix, per = np.arange(len(text)), max(1, 62 // max(width, 1))
            for hi in range(depth, 0, -per):
                key = np.zeros(len(text), np.int64)
                for j in range(max(0, hi - per), hi):
                    key = (key << width) | np.roll(text, -j)
                self.suffix = self.suffix[np.argsort(key[self.suffix], kind="stable")]
        self.bwt = text[self.suffix - 1]
        self.by_symbol = self._ordered(self.bwt)  # place in F -> place in the transform

    def _ordered(self, key: np.ndarray) -> np.ndarray:
        """Stable order of small keys: sorted together with their places."""
        return np.sort((key << self.bits) | np.arange(self.size)) & ((1 << self.bits) - 1)

    def level(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the intervals of single symbols."""
        first = self.text[self.suffix]
        lead = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
        return lead, np.r_[lead[1:], self.size]

    def extended(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All extensions of disjoint intervals by the symbol before them:
        (interval extended, symbol, start, end); ``starts`` ascend."""
        number = np.zeros(self.size + 1, np.int64)
        number[starts] += np.arange(1, len(starts) + 1)
        number[ends] -= np.arange(1, len(starts) + 1)
        source = np.cumsum(number[:-1]) - 1  # -1 outside the intervals
        came, symbol = source[self.by_symbol], self.bwt[self.by_symbol]
        lead = np.flatnonzero(np.r_[True, (came[1:] != came[:-1]) | (symbol[1:] != symbol[:-1])])
        end = np.r_[lead[1:], self.size]
        some = came[lead] >= 0
        return came[lead][some], symbol[lead][some], lead[some], end[some]


def _step(index: FMIndex, starts: np.ndarray, other: np.ndarray, sizes: np.ndarray):
    """Extend intervals in one index and move those of the other in step:
    inside a phrase's interval there, its extensions lie in the order of their
    symbols. (interval extended, symbol, start, start in the other, size)."""
    order = np.argsort(starts)
    source, symbol, lo, hi = index.extended(starts[order], (starts + sizes)[order])
    source, size = order[source], hi - lo
    by = np.argsort(source * (int(symbol.max(initial=0)) + 1) + symbol)  # all differ
    before = np.cumsum(size[by]) - size[by]
    lead = np.flatnonzero(np.r_[True, source[by][1:] != source[by][:-1]]) if len(by) else by
    moved = np.empty(len(by), np.int64)
    moved[by] = other[source[by]] + before - np.repeat(before[lead], np.diff(np.r_[lead, len(by)]))
    return source, symbol, lo, moved, size


def phrases(text: np.ndarray, depth: int, allowed):
    """Yields (words (rows, level), counts) of the phrases without a break, of
    2 to ``depth`` symbols, growing to the left and to the right in turn.
    ``allowed(words)`` says which are handed on and grow."""
    forward, backward = FMIndex(text, max(1, depth - 1)), FMIndex(text[::-1].copy(), max(1, depth - 1))
    starts, ends = forward.level()
    words = text[forward.suffix[starts]][:, None]
    some = words[:, 0] > 0
    starts, sizes, words = starts[some], (ends - starts)[some], words[some]
    back = starts.copy()  # one symbol sorts alike in both texts
    for level in range(2, depth + 1):
        if level % 2:
            source, symbol, back, starts, sizes = _step(backward, back, starts, sizes)
            words = np.column_stack([words[source], symbol])
        else:
            source, symbol, starts, back, sizes = _step(forward, starts, back, sizes)
            words = np.column_stack([symbol, words[source]])
        good = symbol > 0
        good[good] = allowed(words[good])
        starts, back, sizes, words = starts[good], back[good], sizes[good], words[good]
        yield words, sizes


# -- counts over the shards ---------------------------------------------------


def _binary(h: np.ndarray) -> pa.Array:
    """Rows of 64-bit hashes as 8 bytes a word."""
    h = np.ascontiguousarray(h)
    width = 8 * h.shape[1]
    offsets = np.arange(len(h) + 1, dtype=np.int32) * np.int32(width)
    return pa.BinaryArray.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(offsets), pa.py_buffer(h.view(np.uint8))])


def _rows(lang: str, h: np.ndarray, counts: np.ndarray, words: pa.Array | None = None):
    """Batches of at most ROWS grams of a shard."""
    for k in range(0, len(h), ROWS):
        part = slice(k, k + ROWS)
        columns = {"lang": pa.repeat(lang, len(h[part])), "gram": _binary(h[part]), "f": pa.array(counts[part])}
        if words is not None:
            columns["word"] = words[part].cast(pa.string())
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))


def word_counts(docs: DataFrame, seed: int, shard: int) -> DataFrame:
    """(lang, gram, f, word, other): a hash's occurrences, the least and the
    largest word that has it."""

    def run(batches):
        for lang, s in _shards(batches, seed, shard):
            yield from _rows(lang, s.hash[:, None], s.counts, s.words)

    counted = _texts(docs).mapInArrow(run, "lang string, gram binary, f long, word string")
    return counted.groupBy("lang", "gram").agg(F.sum("f").alias("f"), F.min("word").alias("word"), F.max("word").alias("other"))


def _lang_hash(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode()))


def _gram_hash(lang: str, h: np.ndarray) -> np.ndarray:
    out = np.full(len(h), _lang_hash(lang))
    for j in range(h.shape[1]):
        out = mix(out ^ h[:, j]) * np.uint64(0xFF51AFD7ED558CCD)
    return mix(out)


def known_filter(grams: DataFrame) -> np.ndarray:
    """A fixed-size filter of the grams' hashes."""

    def hashed(batches):
        for batch in batches:
            for lang in batch.column(0).unique().to_pylist():
                own = batch.filter(pc.equal(batch.column(0), lang)).column(1)
                h = _gram_hash(lang, np.frombuffer(b"".join(own.to_pylist()), np.uint64).reshape(len(own), -1))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    return hash_filter(grams.select("lang", "gram").mapInArrow(hashed, "h long"))


def phrase_counts(docs: DataFrame, level: int, filters: list, seed: int, shard: int) -> DataFrame:
    """(lang, gram, f) of the phrases of ``level`` words whose parts pass the
    filters; filters[k] is a broadcast filter of the phrases of k + 1 words."""

    def run(batches):
        held = [f.value for f in filters]
        for lang, s in _shards(batches, seed, shard):
            text, h = s.text(in_filter(_gram_hash(lang, s.hash[:, None]), held[0]))
            if not text.any():
                continue

            def allowed(words: np.ndarray) -> np.ndarray:
                n = words.shape[1]
                good = np.ones(len(words), bool)
                # both parts of a phrase, and the phrase itself if it grows
                for part, k in ((slice(0, n - 1), n - 2), (slice(1, n), n - 2), (slice(0, n), n - 1)):
                    if 0 < k < len(held):
                        good[good] = in_filter(_gram_hash(lang, h[words[good, part]]), held[k])  # noqa: B023
                return good

            for words, counts in phrases(text, level, allowed):
                if words.shape[1] == level and len(words):
                    yield from _rows(lang, h[words], counts)

    counted = _texts(docs).mapInArrow(run, "lang string, gram binary, f long")
    return counted.groupBy("lang", "gram").agg(F.sum("f").alias("f"))


# -- scores -------------------------------------------------------------------


def counted(docs: DataFrame, least: int, depth: int, shard: int = SHARD) -> tuple[DataFrame, list[DataFrame]]:
    """All words with their counts, and for each level from 1 word up the
    phrases that occur ``least`` times (lang, gram, f)."""
    spark = docs.sparkSession
    seed = 0
    while True:
        words = stored(word_counts(docs, seed, shard), "words")
        if words.filter("word != other").isEmpty():
            break
        seed += 1  # two words with one hash
    levels, filters = [words.filter(F.col("f") >= least).select("lang", "gram", "f")], []
    for level in range(2, depth + 1):
        filters.append(spark.sparkContext.broadcast(known_filter(levels[-1])))
        levels.append(stored(phrase_counts(docs, level, filters, seed, shard).filter(F.col("f") >= least), f"phrases{level}"))
    return words, levels


def scored(levels: list[DataFrame]) -> DataFrame:
    """(lang, gram, a, l, r, score) of all phrases of two words and more, at
    their lowest-scoring cut."""
    known = levels[0]
    for table in levels[1:]:
        known = known.unionByName(table)
    cuts = [
        table.select("lang", "gram", F.col("f").alias("a"), F.explode(F.expr(f"sequence(1, {n - 1})")).alias("k"))
        for n, table in enumerate(levels[1:], 2)
    ]
    cut = cuts[0]
    for table in cuts[1:]:
        cut = cut.unionByName(table)
    cut = cut.withColumn("first", F.expr("substring(gram, 1, 8 * k)")).withColumn("rest", F.expr("substring(gram, 8 * k + 1)"))
    side = lambda part, f: known.select("lang", F.col("gram").alias(part), F.col("f").alias(f))
    whole = "cast({} as decimal(15, 0))".format  # counts below 10^15: products stay under 38 digits
    score = F.expr(f"(cast(1000000 * {whole('a')} as decimal(22, 0)) * {whole('a')}) div ({whole('l')} * {whole('r')})")
    met = cut.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    return met.groupBy("lang", "gram").agg(F.max("a").alias("a"), lowest.alias("cut")).select("lang", "gram", "a", "cut.l", "cut.r", "cut.score")


def uncovered(phrases_: DataFrame, levels: list[DataFrame], share: int) -> DataFrame:
    """Without phrases that stand inside a longer one of ``share`` percent of
    their occurrences."""
    for n, table in enumerate(levels[2:], 3):
        places = ", ".join(f"struct({i} as i, {m} as m)" for m in range(2, n) for i in range(n - m + 1))
        inner = table.withColumn("at", F.explode(F.expr(f"array({places})"))).select(
            "lang", F.expr("substring(gram, 8 * at.i + 1, 8 * at.m)").alias("gram"), "f"
        )
        most = inner.groupBy("lang", "gram").agg(F.max("f").alias("most"))
        phrases_ = phrases_.join(most, ["lang", "gram"], "left").filter(f"most is null or 100 * most < {share} * a").drop("most")
    return phrases_


def collocations(docs: DataFrame, least: int = LEAST, depth: int = DEPTH, top: int = TOP, share: int = SHARE, shard: int = SHARD) -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``depth`` words: lang, rank,
    phrase, a, l, r, n, score."""
    words, levels = counted(docs, least, depth, shard)
    best = stored(uncovered(scored(levels), levels, share), "scored")

    def ahead(rows: DataFrame, keys: list[str], order: list, rank) -> DataFrame:
        return rows.withColumn("rank", rank().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= top)

    # What can be among the first by score and count gets its words; ranks in
    # parts of a language first, so that its own ranking sorts few rows.
    salted = best.withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(SALTS)))
    order = [F.desc("score"), F.desc("a")]
    kept = ahead(salted, ["lang", "salt"], order, F.rank).drop("rank")
    spelt = (
        kept.withColumn("at", F.explode(F.expr("sequence(0, int(octet_length(gram) / 8) - 1)")))
        .withColumn("one", F.expr("substring(gram, 8 * at + 1, 8)"))
        .join(words.filter(F.col("f") >= least).select("lang", F.col("gram").alias("one"), "word"), ["lang", "one"])
        .groupBy("lang", "salt", "gram", "a", "l", "r", "score")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    )
    order = [*order, F.asc("phrase")]
    first = ahead(ahead(spelt, ["lang", "salt"], order, F.row_number), ["lang"], order, F.row_number)
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return first.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, 'und') AS lang, row_number() OVER () AS d,
        string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]') AS p
        FROM documents),
w AS (SELECT lang, [x FOR x IN string_split_regex(piece, '[ 	]+') IF x <> ''] AS w FROM (SELECT lang, unnest(p) AS piece FROM t)),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g, count(*) AS f
        FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) v(k)) GROUP BY ALL),
c AS (SELECT lang, k, g, string_split(g, ' ') AS w, f FROM g WHERE k > 1 AND f >= 10),
s AS (SELECT c.lang, c.k, c.g, c.f AS a, x.f AS l, y.f AS r, j, (1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS score
        FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN g x ON x.lang = c.lang AND x.k = j AND x.g = array_to_string(c.w[1:j], ' ')
        JOIN g y ON y.lang = c.lang AND y.k = c.k - j AND y.g = array_to_string(c.w[j + 1:c.k], ' ')),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
cover AS (SELECT lang, u AS g, max(f) AS most FROM (SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS u
        FROM c WHERE k = 3) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM g WHERE k = 1 GROUP BY lang),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.g)) AS rank
        FROM best b LEFT JOIN cover v ON v.lang = b.lang AND v.g = b.g WHERE most IS NULL OR 100 * most < 50 * a)
SELECT o.lang, rank, o.g AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
"""
