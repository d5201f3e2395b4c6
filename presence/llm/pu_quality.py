"""Quality classifier by positive-unlabelled learning.

Trusted positives are training rows labelled good; the unlabelled sample is
web text whatever its label; the class prior is the share of good rows among
the training labels. The model adds one learned value per feature bin and
minimises the non-negative unbiased risk: where the estimated negative risk
falls below zero the step undoes it, which stops the fit from calling
unlabelled text bad without limit. Rows labelled bad are used for the prior
only.

The fit reads at most SAMPLE rows of either kind (the rows with the smallest
id hashes, so the same rows at any partitioning); every text is scored.

Nulls: a null text is empty; a null id is scored and never trains. Repeated
rows are scored each. Without a training positive every score is the prior
(0.5 without labels). Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presence.llm.textkit import SPACE, Words, crc_mod, per_slice

SAMPLE = 20_000
BINS = 24
STEPS = 400
RATE = 0.05

FEATURES = [
    "words", "word_length", "capitals", "symbols", "exclaim", "digits", "signs", "signs_only",
    "echo", "distinct", "repeated_runs", "repeated_lines", "line_words", "stops",
]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SIGN = np.zeros(256, bool)
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flags)]
    return (total[bounds[1:]] - total[bounds[:-1]]).astype(np.float64)


def _repeats(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: values equal to an earlier one, and all."""
    n = np.diff(first).astype(np.float64)
    row = np.repeat(np.arange(len(n)), np.diff(first))
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    same = np.zeros(len(v), bool)
    same[1:] = (v[1:] == v[:-1]) & (r[1:] == r[:-1])
    return np.bincount(r[same], minlength=len(n)).astype(np.float64), n


def features(words: Words) -> np.ndarray:
    """(rows, FEATURES) over whole texts; 0 where a row has no words."""
    data, off, first = words.raw, words.offsets, words.first
    n = np.diff(first).astype(np.float64)
    safe = np.maximum(n, 1)
    solid = _per_row(~SPACE[data], off)
    letters = np.maximum(solid - _per_row(_SIGN[data], off), 1)
    h = words.hash
    echo = np.zeros(len(h), bool)
    echo[1:] = h[1:] == h[:-1]
    echo[first[:-1][n > 0]] = False
    s, e = words.cores()
    runs, _, run_first = words.windows(5)
    run_repeats, run_n = _repeats(runs, run_first)
    word_repeats, _ = _repeats(h, first)
    ends = data == 10
    line_row = np.repeat(np.arange(len(n)), np.diff(off).astype(np.int64))
    starts = np.flatnonzero(np.r_[True, ends[:-1] | (line_row[1:] != line_row[:-1])]) if len(data) else np.zeros(0, np.int64)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * np.uint64(0x9E3779B97F4A7C15), out=total[1:])
    at = np.searchsorted(words.starts, np.r_[starts, len(data)])
    has = at[1:] > at[:-1]
    line_hash = (total[at[1:]] - total[at[:-1]])[has]
    owner = line_row[starts][has] if len(starts) else np.zeros(0, np.int64)
    line_first = np.searchsorted(owner, np.arange(len(n) + 1))
    line_repeats, line_n = _repeats(line_hash, line_first)
    last = data[words.ends - 1] if len(h) else data
    stops = np.isin(last, np.frombuffer(b".?!", np.uint8))
    columns = [
        np.log1p(n),
        solid / safe,
        _per_row(_CAPITAL[data], off) / letters,
        _per_row(_SYMBOL[data], off) / safe,
        _per_row(data == 33, off) / safe,
        _per_row(_DIGIT[data], off) / safe,
        _per_row(_SIGN[data], off) / safe,
        _per_row(e <= s, first) / safe,
        _per_row(echo, first) / safe,
        1 - word_repeats / safe,
        run_repeats / np.maximum(run_n, 1),
        line_repeats / np.maximum(line_n, 1),
        n / np.maximum(line_n, 1),
        _per_row(stops, first) / safe,
    ]
    return np.stack(columns, axis=1)


def feature_rows(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``x``, the features as an array."""

    def work(batch: pa.RecordBatch, words: Words) -> pa.RecordBatch:
        x = features(words)
        flat = pa.array(x.ravel())
        offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
        cols = [batch.column(batch.schema.get_field_index(k)) for k in keep]
        return pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(offsets, flat)], names=[*keep, "x"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", x array<double>"
    return docs.select(*keep, "text").mapInArrow(per_slice("text", work, fold=False), schema)


def _sample(rows: DataFrame, salt: int) -> np.ndarray:
    """Features of the SAMPLE rows with the smallest id hashes."""
    top = rows.orderBy(F.xxhash64(F.lit(salt), "doc_id"), "doc_id").limit(SAMPLE)
    got = [r["x"] for r in feature_rows(top, ["doc_id"]).select("x").collect()]
    return np.array(got, np.float64).reshape(len(got), len(FEATURES))


class Model:
    """Additive over feature bins; edges are quantiles of the sample."""

    def __init__(self, edges: list[np.ndarray], weights: np.ndarray, bias: float):
        self.edges, self.weights, self.bias = edges, weights, bias

    def place(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], "right") for i, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        g = self.weights[np.arange(x.shape[1]), self.place(x)].sum(axis=1) + self.bias
        return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """Minimise the non-negative PU risk with the sigmoid loss."""
    both = np.concatenate([positive, unlabelled])
    edges = [np.unique(np.quantile(both[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) for i in range(both.shape[1])]
    model = Model(edges, np.zeros((both.shape[1], BINS)), 0.0)
    bp, bu = model.place(positive), model.place(unlabelled)
    d = both.shape[1]
    cell = np.arange(d) * BINS
    m1, m2 = np.zeros(d * BINS + 1), np.zeros(d * BINS + 1)

    def output(b):
        g = model.weights[np.arange(d), b].sum(axis=1) + model.bias
        return 1 / (1 + np.exp(-np.clip(g, -30, 30)))

    def pull(b, slope):
        out = np.zeros(d * BINS + 1)
        out[:-1] = np.bincount((b + cell).ravel(), weights=np.repeat(slope, d), minlength=d * BINS)
        out[-1] = slope.sum()
        return out

    for step in range(1, STEPS + 1):
        sp, su = output(bp), output(bu)
        # sigmoid loss: of the positive class 1 - s, of the negative class s
        negative = su.mean() - prior * sp.mean()
        dp, du = sp * (1 - sp) / len(sp), su * (1 - su) / len(su)
        if negative >= 0:
            grad = pull(bp, -2 * prior * dp) + pull(bu, du)
        else:
            grad = -(pull(bu, du) - pull(bp, prior * dp))
        grad[:-1] += 1e-4 * model.weights.ravel()
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.99 * m2 + 0.01 * grad**2
        move = RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        model.weights -= move[:-1].reshape(d, BINS)
        model.bias -= move[-1]
    return model


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row. Labels of rows
    whose crc32(id) modulo ``folds`` is ``held`` are never read."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    train = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .filter(F.col("quality").isNotNull() & (crc_mod(F.col("doc_id"), folds) != held))
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
    )
    n, good = train.agg(F.count("*"), F.sum("quality")).first()
    prior = min(max((good or 0) / n, 0.02), 0.98) if n else 0.5
    # the training labels are few next to the texts: find the sample's ids first
    trusted = train.filter("quality = 1").select("doc_id").orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(SAMPLE)
    # SAMPLE ids of eight bytes: a bound of the fit, not of the input
    positive = _sample(texts.join(F.broadcast(trusted), "doc_id", "left_semi"), 7)
    web = texts.filter("doc_id is not null").select("doc_id").orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(SAMPLE)
    unlabelled = _sample(texts.join(F.broadcast(web), "doc_id", "left_semi"), 11)
    model = fit(positive, unlabelled, prior) if len(positive) and len(unlabelled) else None

    def work(batch: pa.RecordBatch, words: Words) -> pa.RecordBatch:
        score = model.score(features(words)) if model else np.full(batch.num_rows, prior)
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        return pa.RecordBatch.from_arrays([ids, pa.array(score)], names=["doc_id", "score"])

    scored = texts.mapInArrow(per_slice("text", work, fold=False), "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(crc_mod(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
