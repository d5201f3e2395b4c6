"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols of a small alphabet (INSULT, THREAT, TARGET, NEGATION,
REPORT, LEARNED, OTHER). LEARNED are whole words and stems (the first 3 to 8
bytes) that stand out in the toxic training rows by a likelihood ratio test. Clauses run to the next sign of punctuation or line break.
Over a clause's symbols, transducers are composed, each rewriting the stream
of the one before: reported speech marks what follows a verb of saying,
negation marks an insult or threat within three words, targets mark an
insult or threat in whose clause somebody is addressed. The last one
accepts clauses and names the matched pattern; isolated words count only as
the clause pattern they stand in. The weights of the patterns (how many
clauses match each, and per hundred words) come from a logistic fit on the
training labels; SAMPLE bounds the rows it reads.

Nulls: a null text is empty; a null id is scored and never trains. Repeated
rows are scored each. Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presence.llm.textkit import Words, crc_mod, hash_spans, lookup, mix, per_slice, stored, word_hashes

SAMPLE = 20_000

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, LEARNED = range(7)
HOSTILE = (INSULT, THREAT, LEARNED)
STEMS = (3, 4, 5, 6, 8, 0)  # bytes from the word's start; 0 is the whole word
# Least ratio statistic of a stem (about one in 10,000 by chance) and least
# share of toxic rows among those that hold it.
LEAST_RATIO, LEAST_SHARE = 15.0, 0.9
LEXICON = {
    INSULT: """trash pathetic idiot idiots idiotic worthless disgusting stupid clown clowns loser losers scum moron morons
        dumb fool fools garbage filth vermin imbecile creep jerk pig pigs ugly freak parasite parasites cretin
        dummkopf idioten dumm abschaum trottel versager widerlich arschloch
        imbécile débile ordure minable dégoûtant crétin connard racaille
        idiota idiotas estúpido estúpida basura imbécil asqueroso patético escoria""",
    THREAT: """kill hurt destroy beat crush punish shoot stab töten umbringen vernichten tuer frapper détruire matar golpear destruir""",
    TARGET: """you your yours yourself u ur they them he she him her his these those people everyone
        du dich dir dein ihr euch sie vous tu te toi votre ton ils elles tú ti usted ustedes vosotros ellos ellas""",
    NEGATION: "not no never isn't aren't wasn't don't without nicht kein keine nie pas jamais ni nunca sin",
    REPORT: "said says say wrote writes claimed claims told reported quoted calls called sagte schrieb dit écrit dijo escribió",
}

# What a pattern may add to a clause's symbol.
NEGATED, REPORTED, AIMED = 8, 16, 32
CORE = 7
PATTERNS = [
    (kind, bits) for kind in HOSTILE for bits in (0, AIMED, NEGATED, NEGATED | AIMED, REPORTED, REPORTED | AIMED, REPORTED | NEGATED)
]


@cache
def lexicon() -> tuple[np.ndarray, np.ndarray]:
    """Sorted word hashes and their symbols."""
    terms = [(w, s) for s, text in LEXICON.items() for w in text.split()]
    known, lead = np.unique(word_hashes([w for w, _ in terms]), return_index=True)
    return known, np.array([terms[i][1] for i in lead])


@dataclass(frozen=True)
class Transducer:
    """``move(state, symbol) -> (state, symbol out)`` from state 0."""

    name: str
    move: object

    def run(self, symbols: list[int]) -> list[int]:
        state, out = 0, []
        for symbol in symbols:
            state, symbol = self.move(state, symbol)
            out.append(symbol)
        return out

    def __rshift__(self, after: Transducer) -> Transducer:
        """Composition: ``after`` reads what this one writes."""

        def move(state, symbol):
            first, second = state or (0, 0)
            first, symbol = self.move(first, symbol)
            second, symbol = after.move(second, symbol)
            return (first, second), symbol

        return Transducer(f"{self.name}>>{after.name}", move)


def _reporting(state: int, symbol: int) -> tuple[int, int]:
    if symbol & CORE == REPORT:
        return 1, symbol
    return state, symbol | REPORTED * (state and symbol & CORE in HOSTILE)


def _negating(state: int, symbol: int) -> tuple[int, int]:
    """State: words that a negation still reaches."""
    if symbol & CORE == NEGATION:
        return 3, symbol
    return max(state - 1, 0), symbol | NEGATED * (state > 0 and symbol & CORE in HOSTILE)


def _aiming(state: int, symbol: int) -> tuple[int, int]:
    if symbol & CORE == TARGET:
        return 1, symbol
    return state, symbol | AIMED * (state and symbol & CORE in HOSTILE)


GRAMMAR = Transducer("reported", _reporting) >> Transducer("negated", _negating) >> Transducer("aimed", _aiming)


@cache
def clause_pattern(symbols: tuple[int, ...]) -> int | None:
    """The strongest pattern of a clause: a threat before an insult, open
    before reported or negated; one aimed at somebody anywhere in the clause
    before one that is not."""
    marked = [s for s in GRAMMAR.run(list(symbols)) if s & CORE in HOSTILE]
    if not marked:
        return None
    if any(s & CORE == TARGET for s in symbols):
        marked = [s | AIMED for s in marked]
    best = min(marked, key=lambda s: (bool(s & (NEGATED | REPORTED)), s & CORE != THREAT))
    bits = best & (NEGATED | REPORTED | AIMED)
    bits = bits & ~AIMED if bits & NEGATED and bits & REPORTED else bits
    return PATTERNS.index((best & CORE, bits))


_BREAK = np.zeros(256, bool)
_BREAK[list(b".!?;:,|")] = True


def stems(words: Words, s: np.ndarray, e: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of at least ``length`` bytes and the hashes of their stems;
    length 0 gives all words, whole, with hashes apart from those of stems."""
    long = np.flatnonzero(e - s >= max(length, 1))
    if not length:
        return long, mix(hash_spans(words.data, s[long], e[long]) + np.uint64(1))
    return long, hash_spans(words.data, s[long], s[long] + length)


def pattern_counts(words: Words, learned: np.ndarray) -> np.ndarray:
    """(rows, PATTERNS + 1): matched clauses by pattern, and words."""
    known, kinds = lexicon()
    n = np.diff(words.first)
    out = np.zeros((len(n), len(PATTERNS) + 1))
    out[:, -1] = n
    s, e = words.cores()
    place = lookup(hash_spans(words.data, s, e), known)
    found = np.where(place >= 0, kinds[place], OTHER)
    for length in STEMS if len(learned) else ():
        long, h = stems(words, s, e, length)
        hit = long[lookup(h, learned) >= 0]
        found[hit[found[hit] == OTHER]] = LEARNED
    at = np.flatnonzero(found)
    symbol = found[at]
    if not np.isin(symbol, HOSTILE).any():
        return out
    # Clause ends: a word that ends in punctuation, is followed by a line
    # break, or is its row's last.
    ends = _BREAK[words.data[words.ends - 1]]
    breaks = np.searchsorted(np.flatnonzero(words.data == 10), words.ends)
    ends[:-1] |= breaks[1:] != breaks[:-1]
    ends[words.first[1:][n > 0] - 1] = True
    clause = np.r_[0, np.cumsum(ends)[:-1]]
    edge = np.flatnonzero(ends) + 1
    begin = np.r_[0, edge[:-1]]
    of = clause[at]
    hot = np.unique(of[np.isin(symbol, HOSTILE)])
    row = np.searchsorted(words.first, begin[hot], "right") - 1
    lo, hi = np.searchsorted(of, hot, "left"), np.searchsorted(of, hot, "right")
    for c, r, a, b in zip(hot, row, lo, hi, strict=True):
        # gaps of other words, no longer than a negation reaches
        symbols, last = [], begin[c] - 1
        for i in range(a, b):
            symbols += [OTHER] * int(min(at[i] - last - 1, 3))
            symbols.append(int(symbol[i]))
            last = at[i]
        found = clause_pattern(tuple(symbols))
        if found is not None:
            out[r, found] += 1
    return out


def inputs(counts: np.ndarray) -> np.ndarray:
    n = np.maximum(counts[:, -1:], 1)
    hits = counts[:, :-1]
    return np.concatenate([np.log1p(hits), np.minimum(100 * hits / n, 10), np.log1p(hits.sum(axis=1, keepdims=True))], axis=1)


def fit(x: np.ndarray, y: np.ndarray, steps: int = 500) -> tuple[np.ndarray, float]:
    """Ridge logistic weights; patterns may only add to the score, but
    negated and reported ones are free."""
    w, b = np.full(x.shape[1], 0.1), -2.0
    scale = np.maximum(x.std(axis=0), 0.05)
    z = x / scale
    free = np.array([bool(bits & (NEGATED | REPORTED)) for _, bits in PATTERNS] * 2 + [False])
    m = v = np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30)))
        g = np.r_[z.T @ (p - y) / len(y) + 1e-3 * w, (p - y).mean()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
        w = np.where(free, w, np.maximum(w, 0))
    return w / scale, float(b)


def learn_stems(known: DataFrame) -> np.ndarray:
    """Hashes of the stems that tell toxic training rows (``toxic`` 0 or 1,
    ``text``) from the others. Rows are counted once per stem; the counts
    meet by stem, and only stems that pass the test reach the driver."""

    def counts(batch: pa.RecordBatch, words: Words) -> pa.RecordBatch:
        s, e = words.cores()
        toxic = batch.column(batch.schema.get_field_index("toxic")).to_numpy(zero_copy_only=False)
        row = words.row
        keys, owners = [], []
        for length in STEMS:
            long, h = stems(words, s, e, length)
            keys.append(h)
            owners.append(row[long])
        key, owner = np.concatenate(keys), np.concatenate(owners)
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        once = np.ones(len(key), bool)
        once[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        key, bad = key[once], toxic[owner[once]] == 1
        each, which = np.unique(key, return_inverse=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(each.view(np.int64)), *(pa.array(np.bincount(which[x], minlength=len(each)).astype(np.int64)) for x in (bad, ~bad))],
            names=["stem", "bad", "good"],
        )

    totals = known.agg(F.sum("toxic"), F.count("*")).first()
    bad_all, all_ = int(totals[0] or 0), totals[1]
    if not 0 < bad_all < all_:
        return np.zeros(0, np.uint64)
    share = bad_all / all_
    per_stem = (
        known.select("toxic", "text")
        .mapInArrow(per_slice("text", counts), "stem long, bad long, good long")
        .groupBy("stem")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .withColumn("n", F.col("bad") + F.col("good"))
    )
    part = lambda k, p: F.when(k > 0, k * F.log(k / (F.col("n") * p))).otherwise(0.0)
    ratio = 2 * (part(F.col("bad"), share) + part(F.col("good"), 1 - share))
    passed = per_stem.filter((F.col("bad") >= LEAST_SHARE * F.col("n")) & (ratio >= LEAST_RATIO)).select("stem").collect()
    return np.sort(np.array([r["stem"] for r in passed], np.int64).view(np.uint64))


def score_texts(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_matched) of every row. Labels
    of rows whose crc32(id) modulo ``folds`` is ``held`` are never read.
    Without training rows of both kinds, an unaimed open match counts 1."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    train = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("toxic").isNotNull() & (crc_mod(F.col("doc_id"), folds) != held))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id")
        .limit(SAMPLE)
    )
    known = stored(texts.join(train, "doc_id"), "labelled").dropDuplicates(["text"])
    learned = learn_stems(known)

    def counted(batch: pa.RecordBatch, words: Words) -> pa.RecordBatch:
        c = pattern_counts(words, learned)
        offsets = pa.array(np.arange(len(c) + 1, dtype=np.int32) * c.shape[1])
        label = batch.column(batch.schema.get_field_index("toxic"))
        return pa.RecordBatch.from_arrays([label, pa.ListArray.from_arrays(offsets, pa.array(c.ravel()))], names=["toxic", "c"])

    rows = (
        known.select("toxic", "text")
        .mapInArrow(per_slice("text", counted), "toxic int, c array<double>")
        # rows without a match all look alike: count them instead
        .groupBy(F.when(F.exists(F.slice("c", 1, len(PATTERNS)), lambda v: v > 0), F.col("c")).alias("c"), "toxic")
        .agg(F.count("*").alias("n"))
        .collect()
    )
    empty = [0.0] * len(PATTERNS) + [1.0]
    x = inputs(np.array([r["c"] or empty for r in rows for _ in range(r["n"])], float).reshape(-1, len(PATTERNS) + 1))
    y = np.array([r["toxic"] for r in rows for _ in range(r["n"])], float)
    if 0 < y.sum() < len(y):
        w, b = fit(x, y)
    else:
        w, b = np.zeros(2 * len(PATTERNS) + 1), -2.0
        w[[i for i, (_, bits) in enumerate(PATTERNS) if not bits & (NEGATED | REPORTED)]] = 2.0

    def scored(batch: pa.RecordBatch, words: Words) -> pa.RecordBatch:
        c = pattern_counts(words, learned)
        p = 1 / (1 + np.exp(-np.clip(inputs(c) @ w + b, -30, 30)))
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        n = c[:, :-1].sum(axis=1).astype(np.int64)
        return pa.RecordBatch.from_arrays([ids, pa.array(p), pa.array(n)], names=["doc_id", "score", "n_matched"])

    out = texts.mapInArrow(per_slice("text", scored), "doc_id long, score double, n_matched long")
    return out.select(
        "doc_id",
        F.coalesce(crc_mod(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "n_matched",
    )
