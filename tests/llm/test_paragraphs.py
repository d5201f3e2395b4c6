"""Duplicate lines and passages against everything compared."""

import random

import numpy as np
import pyarrow as pa

from presence.llm import hyperminhash, paragraphs
from presence.llm.textkit import in_filter
from test_operators import prose, words


def shingles(line):
    w = words(line)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))


def test_near_lines_against_brute_force(spark):
    r, lines = random.Random(9), []
    for k in range(60):
        w = prose(k, r.choice((5, 6, 8, 12, 20, 45, 90))).split()
        for _ in range(r.randint(1, 4)):
            own = list(w)
            for _ in range(r.choice((0, 0, 1, 2))):
                own[r.choice((0, -1, r.randrange(len(own))))] = f"edit{r.randrange(10**6)}"
            lines.append(" ".join(own))
    r.shuffle(lines)
    docs = [(i // 3, "\n".join(lines[i : i + 3])) for i in range(0, len(lines), 3)]
    flat = [(i, first, line) for i, text in docs for first, line in _placed(text)]
    sets = [shingles(line) for _, _, line in flat]
    label = list(range(len(flat)))
    changed = True
    while changed:
        changed = False
        for a in range(len(flat)):
            for b in range(a):
                if label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    low = min(label[a], label[b])
                    old = {label[a], label[b]}
                    label = [low if x in old else x for x in label]
                    changed = True
    groups = {}
    for x, (i, first, _) in zip(label, flat, strict=True):
        groups.setdefault(x, []).append((i, first))
    want = {(i, first, (i, first) != min(g)) for g in groups.values() if len({i for i, _ in g}) > 1 for i, first in g}
    got = paragraphs.near_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert {(x.doc_id, x.first_word, x.removed) for x in got} == want and len(got) == len(want) > 40


def _placed(text):
    at = 0
    for line in text.split("\n"):
        yield at, line
        at += len(line.split())


def test_each_text_of_an_id_is_cut_by_its_own_spans(spark):
    passage = prose(1, 60)
    rows = [
        (1, prose(2, 30) + " " + passage), (2, prose(3, 10) + " " + passage + " tail here"), (2, passage + " other text of the same id"),
        (2, None), (None, passage), (3, "x " * 70_000 + "\n" + passage), (4, f"{'w' * 70_000} {passage} {prose(9, 60)}"), (5, "short line"), (6, "short line"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spans = paragraphs.duplicate_spans(docs)
    out = {(r.doc_id, r.text) for r in paragraphs.cut_spans(docs, spans).collect()}
    assert out == {
        (1, rows[0][1]), (2, prose(3, 10) + " tail here"), (2, "other text of the same id"), (2, None), (None, passage),
        (3, ("x " * 70_000).strip()), (4, f"{'w' * 70_000} {prose(9, 60)}"), (5, "short line"), (6, "short line"),
    }


def test_holders_that_share_different_parts(spark):
    """The first holder has one half of a passage, others the whole."""
    whole = prose(5, 120).split()
    rows = [(1, " ".join([*prose(6, 20).split(), *whole[:60]])), (2, " ".join(whole)), (3, " ".join([*prose(7, 15).split(), *whole]))]
    spans = paragraphs.passages(spark.createDataFrame(rows, "doc_id long, text string")).filter("removed").collect()
    gone = {(x.doc_id, w) for x in spans for w in range(x.first_word, x.first_word + x.n_words)}
    assert {w for d, w in gone if d == 2} == set(range(60))
    assert {w for d, w in gone if d == 3} == set(range(15, 135))


def test_cells_are_joined_many_at_a_time():
    """One call for many cells, small and large, joins what all pairs of each cell join."""
    r, rows = random.Random(4), []
    for cell in range(30):
        common = [r.getrandbits(62) for _ in range(r.randint(5, 40))]
        for k in range(r.choice((2, 3, 7, 64, 65, 90))):
            own = list(common)
            for _ in range(r.randint(0, 5)):
                own[r.randrange(len(own))] = r.getrandbits(62)
            rows.append((cell, k // 2, 1000 * cell + k, sorted(set(own))))
    names = ["cell", "label", "node", "shingles"]
    group = pa.table([pa.array(x) for x in zip(*rows, strict=True)], names=names)
    got = [(a, b) for batch in hyperminhash._bridges(group, 80) for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    sets = {node: set(own) for _, _, node, own in rows}
    assert all(100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a, b in got)

    def joined(links):
        root = {(c, label): (c, label) for c, label, _, _ in rows}
        of = {node: (c, label) for c, label, node, _ in rows}
        for a, b in links:
            x, y = root[of[a]], root[of[b]]
            root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
        return root

    nodes = [[n for c, _, n, _ in rows if c == cell] for cell in range(30)]
    pairs = [(a, b) for ids in nodes for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert joined(got) == joined(pairs) and len(got) == len(set(joined([]).values())) - len(set(joined(got).values())) > 30


def test_only_first_holders_are_read_again(spark, monkeypatch):
    """The pass for the first holders' words is told which documents to read."""
    passage, told = prose(1, 60), []
    docs = spark.createDataFrame([(i, f"{prose(10 + i, 40)} {passage}") for i in range(20)], "doc_id long, text string")
    contexts = paragraphs.contexts

    def asked(docs, wanted, holders=None):
        if holders is not None:
            ids = np.arange(20)
            told.extend(ids[in_filter(paragraphs._holder_key(ids), holders.value)].tolist())
        return contexts(docs, wanted, holders)

    monkeypatch.setattr(paragraphs, "contexts", asked)
    spans = paragraphs.passages(docs).collect()
    assert told == [0] and {(x.doc_id, x.first_word, x.n_words) for x in spans} == {(i, 40, 60) for i in range(20)}
