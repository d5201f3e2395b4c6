"""run() stage by stage against plain Python on whole tables."""

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from presence.llm import pu_quality
from test_operators import words

SF = "/root/testdata/sf0.001"


def near_duplicates(texts):
    """Smallest ids of the components, all pairs compared."""
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {i for i in label if find(i) == i}


def holders(texts, size):
    """How many documents hold each run of ``size`` words."""
    return Counter(g for t in texts.values() for g in {tuple(words(t)[k : k + size]) for k in range(len(words(t)) - size + 1)})


def test_pipeline_against_plain_python(spark, monkeypatch):
    kept = []
    write = corpus_pipeline.stored

    def recorded(df, purpose):
        out = write(df, purpose)
        if purpose in dict(corpus_pipeline.STAGES):
            kept.append(out)
        return out

    monkeypatch.setattr(corpus_pipeline, "stored", recorded)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    packed = corpus_pipeline.run(spark, SF).collect()
    assert len(kept) == 5
    for frame in kept[:-1]:
        assert frame.columns == docs.columns
    start = {r.doc_id: r.text for r in docs.collect()}
    good, single, cut, clean = ({r.doc_id: r.text for r in frame.collect()} for frame in kept[:-1])

    judged = pu_quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert good == {r.doc_id: start[r.doc_id] for r in judged if r.predicted == 1}
    keep = near_duplicates(good)
    assert single == {i: t for i, t in good.items() if i in keep}

    # Substring dedup: what stays is in order, no passage of over 60 words
    # stands in two documents, documents that share no run are left alone.
    common = {g for g, n in holders(single, 8).items() if n > 1}
    for i, t in cut.items():
        rest = iter(words(single[i]))
        assert all(w in rest for w in words(t))
    for i, t in single.items():
        w = words(t)
        if not any(tuple(w[k : k + 8]) in common for k in range(len(w) - 7)):
            assert cut.get(i, t) == t
    assert not [g for g, n in holders(cut, 60).items() if n > 1]

    # Decontamination: whole items are gone, the others' texts unchanged.
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    spaced = [f" {' '.join(words(t))} " for t in items if len(words(t)) >= 10]
    held = {i for i, t in cut.items() if any(s in f" {' '.join(words(t))} " for s in spaced)}
    assert clean == {i: cut[i] for i in clean} and not held & set(clean)
    windows = {tuple(words(t)[k : k + 3]) for t in items for k in range(len(words(t)) - 2)}
    for i in set(cut) - set(clean):
        w = words(cut[i])
        assert any(tuple(w[k : k + 3]) in windows for k in range(len(w) - 2))

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, got, ends = set(), set(), {}
    for i, t in clean.items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want |= {(i, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        got.add((r.doc_id, r.piece, r.start, r.length, r.ids_crc32))
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert got == want and len(packed) == len(want) and max(ends.values()) <= 2048
