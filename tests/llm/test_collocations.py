"""Collocations against counts in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from presence.llm import collocations, textkit

TABLE = "doc_id long, lang string, text string, gram string, f long, n int"


def plain(rows, least, depth, top, share):
    counts = {}
    for _, lang, text, *_ in rows:
        fold = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", fold):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, depth + 1):
                counts.setdefault(lang or "und", Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        total = sum(v for g, v in f.items() if len(g) == 1)
        some = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        best = []
        for g, a in some.items():
            score, k = min((1000000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            longer = [b for h, b in some.items() if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h)))]
            if not any(100 * b >= share * a for b in longer):
                best.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total, -score))
    return sorted(out)


def made(seed, n, vocabulary):
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 60))]
        if r.random() < 0.3:
            w += ["New", "york", "CITY", "hall"]
        text = "".join(x + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", ":", " ", " \r"]) for x in w)
        out.append((i % 50 or None, r.choice(["en", "fr", None, "und"]), text, "g", 1, 2))
    return [*out, (None, None, None, None, None, None), (1, "de", "", None, None, None), (1, "en", " .,!", None, None, None)]


def test_against_plain_counts(spark):
    rows = made(1, 900, ["a", "b", "Ä", "dé", "e", "f-g", "|", "あ"] + [f"w{k}" for k in range(12)])
    table = spark.createDataFrame(rows, TABLE).repartition(3)
    for depth, least, top, shard in ((3, 10, 2000, 1 << 20), (3, 5, 7, 200), (4, 4, 50, 500), (2, 3, 9, 1)):
        got = collocations.collocations(table, least=least, depth=depth, top=top, shard=shard).collect()
        want = plain(rows, least, depth, top, 50)
        assert sorted(tuple(x) for x in got) == want and len(want) > 5


def test_counts_of_every_level():
    r = np.random.default_rng(5)
    for size in (0, 1, 40, 3000):
        text = np.r_[0, r.integers(0, 6, size), 0]
        want = Counter()
        for k in range(2, 6):
            for i in range(len(text) - k + 1):
                if text[i : i + k].all():
                    want[tuple(text[i : i + k].tolist())] += 1
        got = {}
        for words, counts in collocations.phrases(text, 5, lambda w: np.ones(len(w), bool)):
            got.update(zip(map(tuple, words.tolist()), counts.tolist(), strict=True))
        assert got == dict(want)


def test_a_collision_changes_the_seed(spark, monkeypatch):
    rows = [(i, "en", "one two three four", None, None, None) for i in range(12)]
    table = spark.createDataFrame(rows, TABLE).coalesce(1)
    seeds, count = [], collocations.word_counts

    def collided(docs, seed, shard):
        seeds.append(seed)
        out = count(docs, seed, shard)
        return out if seed else out.withColumn("other", out.word.substr(2, 9))

    monkeypatch.setattr(collocations, "word_counts", collided)
    assert collocations.collocations(table).count() == 2 and seeds == [0, 1]


def test_exact_scores_of_large_counts(spark):
    import pyspark.sql.functions as F

    big = [3 * 10**13 + 7, 10**13 + 1, 5 * 10**13 + 3]
    one = spark.createDataFrame([("en", bytes(8), big[0]), ("en", b"1" * 8, big[2])], "lang string, gram binary, f long")
    two = spark.createDataFrame([("en", bytes(8) + b"1" * 8, big[1])], "lang string, gram binary, f long")
    (x,) = collocations.scored([one, two]).withColumn("score", F.col("score").cast("long")).collect()
    assert x.score == 1000000 * big[1] ** 2 // (big[0] * big[2])


def test_filter_passes_what_it_holds(spark):
    h = np.random.default_rng(6).integers(0, 2**63, (5000, 2)).astype(np.uint64)
    table = spark.createDataFrame([("en" if i % 2 else "fr", bytes(x)) for i, x in enumerate(h.view(np.uint8).reshape(len(h), -1))], "lang string, gram binary")
    held = collocations.known_filter(table)
    for k, lang in enumerate(("fr", "en")):
        assert textkit.in_filter(collocations._gram_hash(lang, h[k::2]), held).all()
    other = np.random.default_rng(7).integers(0, 2**63, (5000, 2)).astype(np.uint64)
    assert textkit.in_filter(collocations._gram_hash("en", other), held).mean() < 0.05


def test_words_of_pieces():
    d, breaks = collocations._cut(pa.array(["Ab  c.d", "", "e", " ,x y\n"]))
    assert d.to_pylist() == ["ab", "c", "d", "e", "x", "y"] and breaks.tolist() == [2, 3, 4, 6]


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], TABLE)).collect() == []
