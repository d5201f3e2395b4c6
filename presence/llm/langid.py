"""Language of pages by Bayesian evidence fusion.

Text likelihood: byte trigrams inside words, hashed to BUCKETS, counted per
language over all labelled documents and smoothed; a page's sum is tempered
to the weight of at most WEIGHT trigrams, since neighbouring trigrams are not
independent. Declared markup language and address path code: the probability
of the declaration given the language, from counts over all pages against
their text label, smoothed to the declaration's overall share, so a
declaration that does not follow the text counts for nothing. Prior of the
language: the host's counts smoothed to those of its address suffix, those
smoothed to the corpus, the page itself left out. All counts are grouped
aggregations. The languages are those of the documents' ``lang`` column.

Nulls: null html is empty, null urls and missing declarations are evidence of
their own kind; rows of documents without a language do not train. Without
any language (no documents) the answer is null. Repeated rows are judged
each. Empty tables give no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presence.llm.pagediff import HOST, RAW
from presence.llm.textkit import LOWER, SPACE, column, raw, slices, stored

BUCKETS = 1 << 14
WEIGHT = 60.0
SMOOTH = 0.5
HOST_WEIGHT, SUFFIX_WEIGHT, SIGN_WEIGHT = 5.0, 20.0, 10.0

DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-zA-Z]{2,3})", re.I)
PATH_CODE = re.compile(r"^/([a-zA-Z]{2})(?:[-_][a-zA-Z]{2})?(?:/|\Z)")
MARKUP = re.compile(rf"<!--.*?-->|<({'|'.join(sorted(RAW))})\b.*?</\1\s*>|<[^>]*>", re.S | re.I)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams without blanks, and their rows."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = LOWER[data].astype(np.uint32)
    code = low[:-2] * np.uint32(0x01000193) + low[1:-1] * np.uint32(0x85EBCA6B) + low[2:] * np.uint32(0xC2B2AE35)
    code ^= code >> np.uint32(15)
    blank = SPACE[data]
    inside = ~(blank[:-2] | blank[1:-1] | blank[2:])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside &= row[:-2] == row[2:]
    return (code[inside] & np.uint32(BUCKETS - 1)).astype(np.int64), row[:-2][inside]


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all documents; a task hands on one row per
    language and bucket at most."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            col = column(batch, "text")
            langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
            for a, b in slices(col):
                bucket, row = trigrams(*raw(col.slice(a, b - a)))
                own = np.array([hash(x) for x in langs[a:b]])
                for lang in set(langs[a:b]):
                    part = bucket[own[row] == hash(lang)]
                    total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    total[lang] += np.bincount(part, minlength=BUCKETS)
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "bucket", "n"]
            )

    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang is not null")
    return rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def model(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (languages, BUCKETS): BUCKETS numbers
    per language, whatever the corpus."""
    rows = trigram_counts(docs).toPandas()
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((len(langs), BUCKETS))
    np.add.at(counts, (np.searchsorted(langs, rows["lang"]) if langs else [], rows["bucket"]), rows["n"])
    return langs, np.log(counts + SMOOTH) - np.log(counts.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS)


def page_evidence(pages: DataFrame, table: np.ndarray) -> DataFrame:
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            col = column(batch, "html")
            for a, b in slices(col):
                part = batch.slice(a, b - a)
                html = col.slice(a, b - a).to_pylist()
                urls = part.column(part.schema.get_field_index("url")).to_pylist()
                bucket, row = trigrams(*raw(pa.array([MARKUP.sub(" ", h) for h in html], pa.string())))
                n = np.bincount(row, minlength=len(html))
                sums = np.stack([np.bincount(row, weights=t[bucket], minlength=len(html)) for t in table], axis=1)
                sums *= np.minimum(1.0, WEIGHT / np.maximum(n, 1))[:, None]
                found = [HOST.match(u or "") for u in urls]
                hosts = [m[1].lower() if m else "" for m in found]
                codes = [PATH_CODE.match(m[2]) if m else None for m in found]
                marks = [DECLARED.search(h[:4096]) or DECLARED.search(h) for h in html]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(part.schema.get_field_index("page_id")),
                        part.column(part.schema.get_field_index("url")),
                        pa.array(hosts),
                        pa.array([h.split(":")[0].rpartition(".")[2] for h in hosts]),
                        pa.array([m[1].lower() if m else "" for m in marks]),
                        pa.array([m[1].lower() if m else "" for m in codes]),
                        pa.array(list(sums), pa.list_(pa.float64())),
                    ],
                    names=["page_id", "url", "host", "suffix", "declared", "path_code", "ll"],
                )

    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )
    return rows.mapInArrow(
        run, "page_id long, url string, host string, suffix string, declared string, path_code string, ll array<double>"
    )


def _tally(rows: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """Pages per text label (an array), by key."""
    return rows.groupBy(key).agg(F.array(*[F.count_if(F.col("label") == i) for i in range(n)]).alias(name))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(page_id, url, host, declared, lang, confidence, text_lang) per page."""
    langs, table = model(docs)
    n = len(langs)
    rows = page_evidence(pages, table if n else np.zeros((1, BUCKETS)))
    names = F.array(*[F.lit(x) for x in langs]) if n else F.array(F.lit(None).cast("string"))
    n = max(n, 1)
    rows = stored(rows.withColumn("label", (F.array_position("ll", F.array_max("ll")) - 1).cast("int")), "evidence")
    totals = rows.agg(F.count("*"), *[F.count_if(F.col("label") == i) for i in range(n)]).first()
    share = [(totals[1 + i] + 1) / (totals[0] + n) for i in range(n)]
    per_lang = [totals[1 + i] for i in range(n)]
    corpus = F.array(*[F.lit(float(p)) for p in share])
    sizes = F.array(*[F.lit(float(c)) for c in per_lang])
    joined = rows
    for key in ("host", "suffix", "declared", "path_code"):
        joined = joined.join(_tally(rows, key, n, f"n_{key}"), key)
    every = f"sequence(0, {n - 1})"
    # the page's own label is taken out of every count
    mine = "int(i = label)"
    total = lambda c: f"(aggregate({c}, 0L, (s, x) -> s + x) - 1)"
    suffix = f"(n_suffix[i] - {mine} + {SUFFIX_WEIGHT} * corpus[i]) / ({total('n_suffix')} + {SUFFIX_WEIGHT})"
    host = f"(n_host[i] - {mine} + {HOST_WEIGHT} * p_suffix[i]) / ({total('n_host')} + {HOST_WEIGHT})"
    sign = lambda c: (
        f"(n_{c}[i] - {mine} + {SIGN_WEIGHT} * ({total(f'n_{c}')} + 1) / {float(totals[0] + 1)}) / (sizes[i] - {mine} + {SIGN_WEIGHT})"
    )
    scored = (
        joined.withColumn("corpus", corpus)
        .withColumn("sizes", sizes)
        .withColumn("p_suffix", F.expr(f"transform({every}, i -> {suffix})"))
        .withColumn("p_host", F.expr(f"transform({every}, i -> {host})"))
        .withColumn("score", F.expr(f"transform({every}, i -> ll[i] + ln(p_host[i]) + ln({sign('declared')}) + ln({sign('path_code')}))"))
        .withColumn("best", F.array_max("score"))
    )
    at: Column = F.array_position("score", F.col("best"))
    return scored.select(
        "page_id",
        "url",
        "host",
        "declared",
        F.element_at(names, at.cast("int")).alias("lang"),
        F.expr("1 / aggregate(score, 0D, (s, x) -> s + exp(x - best))").alias("confidence"),
        F.element_at(names, F.col("label") + 1).alias("text_lang"),
    )
