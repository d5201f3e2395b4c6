"""The grammar changes decisions in all four languages, and held-out recall."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from presence.llm import toxgrammar
from presence.llm.textkit import words_of
from test_operators import prose

# (open, negated, reported, threat)
CLAUSES = {
    "en": ("you are an idiot", "you are not an idiot", "she said you are an idiot", "they will destroy you"),
    "de": ("du bist so dumm", "du bist nicht dumm", "sie sagte du bist dumm", "wir vernichten dich"),
    "fr": ("tu es un crétin", "tu es pas un crétin", "il dit tu es un crétin", "frapper vous"),
    "es": ("tú eres idiota", "tú nunca eres idiota", "ella dijo tú eres idiota", "destruir vosotros"),
}


def made(seed):
    r = random.Random(seed)
    rows = []
    for lang, kinds in CLAUSES.items():
        for k, clause in enumerate(kinds):
            for _ in range(25):
                own = prose(r.randrange(10**9), r.randint(15, 40)).split()
                at = r.randrange(len(own))
                rows.append((" ".join(own[:at]) + ". " + clause + ". " + " ".join(own[at:]), int(k in (0, 3)), lang, k))
        rows += [(prose(r.randrange(10**9), 24), 0, lang, 4) for _ in range(50)]
    return rows


def accuracy(fold, train, test):
    none = np.zeros(0, np.uint64)
    count = lambda rows: fold(toxgrammar.pattern_counts(words_of(pa.array([t for t, *_ in rows])), none))
    w, b = toxgrammar.fit(toxgrammar.inputs(count(train)), np.array([y for _, y, *_ in train], float))
    score = 1 / (1 + np.exp(-(toxgrammar.inputs(count(test)) @ w + b)))
    right = (score >= 0.3).astype(int) == np.array([y for _, y, *_ in test])
    return {(lang, k): right[[i for i, x in enumerate(test) if x[2:] == (lang, k)]].mean() for _, _, lang, k in test}


def test_negated_and_reported_clauses_are_told_apart():
    train, test = made(1), made(2)
    with_grammar = accuracy(lambda c: c, train, test)
    assert min(with_grammar.values()) >= 0.95, with_grammar

    def merged(c):  # every pattern counts as its plain kind: a list of words
        out = np.zeros_like(c)
        out[:, -1] = c[:, -1]
        for i, (kind, _) in enumerate(toxgrammar.PATTERNS):
            out[:, toxgrammar.PATTERNS.index((kind, 0))] += c[:, i]
        return out

    without = accuracy(merged, train, test)
    assert np.mean([without[lang, k] for lang in CLAUSES for k in range(3)]) < 0.75, without


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.1"])
def test_held_out_recall_by_language(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = toxgrammar.score_texts(docs, labels).filter("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    rows = held.groupBy("lang", "toxic").agg(F.count("*").alias("n"), F.sum("predicted").alias("found")).collect()
    for r in rows:
        assert r.found >= 0.9 * r.n if r.toxic else r.found <= 0.02 * r.n, r
