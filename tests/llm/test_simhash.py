"""SimHash groups against all pairs compared."""

import random

import numpy as np
import xxhash

from presence.llm import simhash
from test_operators import DOCS, prose, rows, words


def plain(text, shingle=3):
    w = words(text)
    grams = [" ".join(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def grouped(items):
    """Smallest reachable id, over (id, fingerprint) rows."""
    label = {f: min(i for i, g in items if g == f) for _, f in items}
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                if (a ^ b).bit_count() <= 2 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_near_duplicates_against_brute_force(spark):
    base = prose(1, 200).split()
    made = [(100 + k, " ".join([*base[:k], "zz", *base[k + 1 :]])) for k in range(0, 200, 9)]
    extra = [(i, t, None, None, 0, 0.0, 0) for i, t in made]
    table = spark.createDataFrame(rows() + extra, DOCS).repartition(4)
    want = [(r[0], plain(r[1])) for r in rows() + extra]
    label = grouped([x for x in want if x[0] is not None])
    for posting in (256, 2):  # compared in their postings, and through variants
        got = simhash.near_duplicates(table, posting=posting).collect()
        assert sorted((str(x.doc_id), x.fingerprint, str(x.component_id)) for x in got) == sorted(
            (str(i), f"{f:016x}", str(None if i is None else label[f])) for i, f in want
        )


def test_links_of_planted_fingerprints(spark):
    r, fps = random.Random(4), set()
    for _ in range(40):
        seed = r.getrandbits(64)
        fps.add(seed)
        for _ in range(r.randint(0, 30)):  # chains whose ends are far apart
            seed ^= sum(1 << b for b in r.sample(range(64), r.choice((1, 2, 3))))
            fps.add(seed)
    top = r.getrandbits(64)
    fps |= {top ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)}  # one full posting
    label = grouped([(f, f) for f in fps])
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    nodes = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    for posting in (256, 16):
        pairs = [(x.a, x.b) for x in simhash.links(nodes, posting).collect()]
        assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in pairs)
        root = {signed(f): signed(f) for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        groups, want = {}, {}
        for f in fps:
            groups.setdefault(find(signed(f)), set()).add(f)
            want.setdefault(label[f], set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_long_texts_are_hashed_in_parts(monkeypatch):
    w = prose(3, 700).split()
    text = " ".join(w).encode()
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    monkeypatch.setattr(simhash, "SHINGLES", 50)
    assert simhash.fingerprint(text, ends - [len(x) for x in w], ends, 3) == plain(" ".join(w))


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
