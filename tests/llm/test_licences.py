"""Licence finds against all spans tried."""

import random

import numpy as np
import pyarrow as pa

from presence.llm import licences
from presence.llm.textkit import words_of
from test_operators import prose


def finds(text):
    words = words_of(pa.array([text]))
    pair, at = licences.bigrams(words)
    hit = np.flatnonzero(licences.lookup(pair, licences.templates()[1]) >= 0)
    return [(*licences.TEMPLATES[t][:2], start, n, score) for t, start, n, score in licences._finds(pair, at, hit)]


def best_span(text, t):
    """The best Dice over all spans of at most 1.5 times the template."""
    pair = licences.bigrams(words_of(pa.array([text])))[0].tolist()
    own = set(licences.templates()[0][t].tolist())
    best = 0.0
    for a in range(len(pair)):
        seen = set()
        for b in range(a, min(len(pair), a + int(1.5 * len(own)))):
            seen.add(pair[b])
            best = max(best, 2 * len(seen & own) / (len(seen) + len(own)))
    return best


def edited(r, text, edits):
    w = text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"edit{r.randrange(999)}"
    return " ".join(w)


def test_edited_copies_in_prose_against_brute_force():
    r = random.Random(3)
    whole = [t for t, (_, _, text) in enumerate(licences.TEMPLATES) if len(text.split()) >= 25]
    for k in range(40):
        t = r.choice(whole)
        name, form, text = licences.TEMPLATES[t]
        # everyday bigrams of the template stand near the copy
        near = " under the terms we sell the software to the people and of the house in the rights to use "
        doc = prose(k, 30) + near + edited(r, text, r.randint(0, 4)) + near + prose(k + 100, 30)
        best = best_span(doc, t)
        got = [f for f in finds(doc) if f[:2] == (name, form)]
        if best >= 0.8:
            assert len(got) == 1 and abs(got[0][4] - best) < 1e-12, (name, form, best, finds(doc))
        else:
            assert not got


def test_a_short_form_does_not_hide_the_text():
    text = next(x for n, f, x in licences.TEMPLATES if (n, f) == ("MIT", "text"))
    header = next(x for n, f, x in licences.TEMPLATES if (n, f) == ("Apache-2.0", "header"))
    r = random.Random(5)
    for edits in (0, 1, 3):
        got = finds(prose(1, 20) + " " + edited(r, text, edits) + " " + prose(2, 20) + " " + edited(r, header, min(edits, 1)))
        assert [f[:2] for f in got] == [("MIT", "text"), ("Apache-2.0", "header")]


def test_copies_in_a_row_and_ties(spark):
    text = next(x for n, f, x in licences.TEMPLATES if (n, f) == ("MIT", "text"))
    rows = [(1, " ".join([text] * 3)), (1, " ".join([text] * 3)), (2, None), (3, ""), (None, text), (4, "a " * 50_000 + text)]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    n = len(text.split())
    assert sorted((str(x.doc_id), x.first_word, x.n_words, x.dice) for x in got) == sorted(
        [("1", k * n, n, 1.0) for k in range(3)] * 2 + [("None", 0, n, 1.0), ("4", 50_000, n, 1.0)]
    )
