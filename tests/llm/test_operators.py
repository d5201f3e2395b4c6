"""The ten operators on small inputs: edge rows, brute force, round trips."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from presence.llm import (
    components,
    decontaminate,
    hyperminhash,
    langid,
    ledger,
    licences,
    packing,
    pagediff,
    paragraphs,
    pu_quality,
    textkit,
    toxgrammar,
)

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, h long"
BLANK = "[\x20\x09-\x0d]+"


def prose(seed: int, n: int = 120) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("bcdfglmnrst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(n))


BASE = prose(1)
PASTED = prose(2, 70)


def rows():
    texts = [
        BASE, BASE, BASE.replace(BASE.split()[60], "zzz", 1), None, "", "  \n\t ", "one two", "One  two", prose(3, 20_000),
        "x" * 300_000, prose(4) + " " + PASTED + " " + prose(5), prose(6) + " " + PASTED, prose(7), "ab ab " * 400, "\0 it's <|x Σ",
    ]
    out = [(i, t, "en", "s", None if t is None else len(t), 0.5, 7) for i, t in enumerate(texts)]
    return [*out, (None, BASE, None, None, None, None, None), (7, "One  two", "en", "s", 8, 0.5, 7)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return [w for w in re.split(BLANK, (text or "").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}))) if w]


def test_words_match_a_plain_split():
    texts = [t for _, t, *_ in rows()]
    got = textkit.words_of(pa.array([t or "" for t in texts]))
    for i, t in enumerate(texts):
        a, b = got.first[i : i + 2]
        mine = [got.data[s:e].tobytes().decode() for s, e in zip(got.starts[a:b], got.ends[a:b], strict=True)]
        assert mine == words(t)
    first = {}
    for h, s, e in zip(got.hash.tolist(), got.starts, got.ends, strict=True):
        assert first.setdefault(got.data[s:e].tobytes(), h) == h
    assert len(set(first.values())) == len(first)


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 1), (20, 21), (5, 5), (None, 4)] + [(100 + i, 101 + i) for i in range(12)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys((1, 2, 3, 7, 8, 9), 1), 20: 20, 21: 20, **{100 + i: 100 for i in range(13)}}


def brute_components(pairs, shingle, percent):
    sets = {}
    for i, t in pairs:
        w = words(t)
        sets[i] = {tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set()
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return sets, label


def test_near_duplicates_against_brute_force(spark, docs):
    r = random.Random(5)
    chain = [BASE.split()]
    for _ in range(25):  # a chain of edits: neighbours near, ends apart
        w = list(chain[-1])
        w[r.randrange(len(w))] = f"w{r.randrange(10**6)}"
        chain.append(w)
    made = [(1000 + i, " ".join(w)) for i, w in enumerate(chain)] + [(2000 + i, prose(50 + i, 4 + i)) for i in range(8)]
    table = spark.createDataFrame(made, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    pairs = [(i, t) for i, t in made + [(x[0], x[1]) for x in rows()] if i is not None]
    for shingle in (4, 5):
        sets, label = brute_components(pairs, shingle, 80)
        got = hyperminhash.near_duplicates(table, shingle).collect()
        assert len(got) == table.count()
        for x in got:
            if x.doc_id is None:
                assert x.kept and x.component_id is None
            else:
                assert (x.n_shingles, x.component_id, x.kept) == (len(sets[x.doc_id]), label[x.doc_id], label[x.doc_id] == x.doc_id)


def test_packing_round_trip(docs):
    tokenizer = Tokenizer.from_file(PATH)
    texts = [t or "" for _, t, *_ in rows()]
    for t, ids in zip(texts, packing.token_ids(texts, PATH), strict=True):
        assert ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    got = packing.pack(packing.token_pieces(docs, PATH)).collect()
    by_doc = {}
    for x in got:
        by_doc.setdefault(x.doc_id, []).append(x)
    for i, t, *_ in rows():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want = {(k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))}
        assert {(x.piece, x.start, x.length, x.ids_crc32) for x in by_doc[i]} == want
    ends = {}
    for x in sorted(got, key=lambda x: (x.sequence_id, x.offset)):
        assert x.offset == ends.get(x.sequence_id, 0)
        ends[x.sequence_id] = x.offset + x.length
    assert max(ends.values()) <= 2048


def test_fullest_is_best():
    r = random.Random(3)
    for _ in range(200):
        counts = {r.randint(1, 30): r.randint(1, 4) for _ in range(r.randint(1, 6))}
        room = r.randint(0, 60)
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1)}
        got = packing.fullest(counts, room)
        assert sum(got) == max(s for s in sums if s <= room)
        assert all(got.count(x) <= counts[x] for x in got)


def test_ledger_counts(docs):
    got = {x.doc_id: x for x in ledger.apply_policy(ledger.ledger(docs), 2).collect()}
    for i, t, *_ in rows():
        w = [x for x in re.split(BLANK, t or "") if x]
        seen, hit = {}, set()
        for k in range(len(w) - 4):
            seen.setdefault(tuple(w[k : k + 5]), []).append(k)
        for places in seen.values():
            if len(places) > 1:
                hit.update(p + j for p in places for j in range(5))
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_repeat_words) == (len(w), sum(map(len, w)), len(hit))
        assert x.base_failed == (len(w) < 10 or 100 * len(hit) > 20 * len(w)) and not (x.base_failed and x.kept)
    lone = {x.rule: x for x in ledger.ablations(ledger.ledger(docs), 2).collect()}
    assert lone["too_few_words"].n_failed == sum(len(words(t)) < 10 for _, t, *_ in rows())


def test_pages():
    page = (
        "<html lang=en><head><title>t</title><script>if (a < b) '</p>'</script></head><body><header>H</header><nav>N</nav>"
        "<article><h1>A &amp; B</h1><p>One<b>two</b>\n three<br>four<section class='comments'>C</section><div class=ad>X</div></article>"
        "<footer>F</footer>"
    )
    text, main = pagediff.blocks(page)
    assert [t for t, m in zip(text, main, strict=True) if m] == ["A & B", "Onetwo three four"]
    assert pagediff.blocks("") == ([], []) and pagediff.blocks("plain < text &am") == (["plain < text &am"], [False])
    a, b = list("xabcy"), list("xbacy")
    assert len(pagediff.common(a, b)) == 4


def test_page_differencing(spark):
    frame = "<div><p>Menu here</p><p>{}</p><p>Contact us</p></div>"
    pages = [(i, f"http://h/a/{i}", frame.format(f"text {i}")) for i in range(5)]
    pages += [(10, None, None), (11, "http://alone/x", "<p>Only</p>"), (12, "http://h/b", "<article>Marked</article>")]
    got = {r.page_id: r.text for r in pagediff.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"text {i}" for i in range(5)}, 10: "", 11: "Only", 12: "Marked"}


def test_page_differencing_inside_marks(spark):
    """A shared box goes, a shared paragraph stays; the mark with the page's own text is believed."""
    box = "<div><p>Share this</p><p>Follow us</p></div>"
    page = "<article><h1>Title {0}</h1><p>Same words in both</p>" + box + "<p>own text {0}</p></article>"
    card = "<main><p>Same words in both</p><p>long own text {0} of this page</p>" + box + "<article>Card</article></main>"
    pages = [(i, f"http://h/a/{i}", page.format(i)) for i in range(4)] + [(10 + i, f"http://c/a/{i}", card.format(i)) for i in range(3)]
    pages += [(20, "http://d/a", page.format(9)), (20, "http://d/a", page.format(9)), (21, "http://d/b", page.format(9)), (22, "http://e/a", page.format(9))]
    rows = pagediff.main_text(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()
    whole = "Title 9 Same words in both Share this Follow us own text 9"
    assert sorted((r.page_id, r.text) for r in rows) == sorted(
        [(i, f"Title {i} Same words in both own text {i}") for i in range(4)]
        + [(10 + i, f"Same words in both long own text {i} of this page Card") for i in range(3)]
        + [(20, whole), (20, whole), (21, whole), (22, whole)]
    )
    # boxes that hold most of the text are no template
    assert pagediff.own_text("<article><h1>A</h1><div><p>all the text</p></div></article>", [1]) == "A all the text"


def test_leaks(spark, docs):
    item = "A train leaves Rome at 9 with 120 seats and travels 300 km in 4 hours before Anna boards it near the old bridge"
    changed = item.replace("120", "85").replace("300", "410").replace("Anna", "Peter")
    bench = spark.createDataFrame([(1, item), (2, None), (3, "one two"), (4, prose(9, 30))], "item_id long, text string")
    extra = [(50, prose(8) + " " + item + " " + prose(10)), (51, prose(11) + " " + changed), (52, prose(12) + " " + prose(9, 30)), (53, prose(13))]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id): r.kind for r in decontaminate.leaks(table, bench).collect()}
    assert got == {(50, 1): "verbatim", (51, 1): "reparameterised", (52, 4): "verbatim", (6, 3): "verbatim", (7, 3): "verbatim"}


def test_spans_and_cut(docs):
    spans = paragraphs.duplicate_spans(docs)
    removed = {r.doc_id for r in spans.filter("removed").collect()}
    assert 11 in removed and not removed & {4, 5, 7, 8, 9, 10, 12}
    out = {r.doc_id: r for r in paragraphs.cut_spans(docs, spans).filter("doc_id is not null").collect()}
    assert out[10].text == rows()[10][1] and prose(6) in out[11].text and PASTED not in out[11].text
    assert out[11].n_chars == len(out[11].text)


def test_licences(spark):
    text = next(t for n, f, t in licences.TEMPLATES if n == "MIT" and f == "text")
    docs = spark.createDataFrame([(1, prose(1) + "\n" + text + "\n" + prose(2)), (2, prose(3)), (3, None)], "doc_id long, text string")
    got = licences.scan(docs).collect()
    assert [(r.doc_id, r.licence, r.form, r.first_word, r.dice) for r in got] == [(1, "MIT", "text", 120, 1.0)]


def test_grammar_patterns():
    kinds = {k: toxgrammar.PATTERNS.index(v) for k, v in {
        "plain": (toxgrammar.INSULT, 0), "aimed": (toxgrammar.INSULT, toxgrammar.AIMED),
        "negated": (toxgrammar.INSULT, toxgrammar.NEGATED | toxgrammar.AIMED), "said": (toxgrammar.INSULT, toxgrammar.REPORTED | toxgrammar.AIMED),
    }.items()}
    texts = {"plain": "what trash this is", "aimed": "you are an idiot", "negated": "you are not an idiot", "said": "he said you are an idiot"}
    none = np.zeros(0, np.uint64)
    for name, text in texts.items():
        counts = toxgrammar.pattern_counts(textkit.words_of(pa.array([text])), none)[0]
        assert np.flatnonzero(counts[:-1]).tolist() == [kinds[name]]


@pytest.mark.parametrize("name, least", [("quality", 0.95), ("toxic", 0.9)])
def test_held_out_accuracy(spark, name, least):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    found = (pu_quality.classify if name == "quality" else toxgrammar.score_texts)(read("documents"), read("labels"))
    held = found.filter("held_out").join(read("labels"), "doc_id").collect()
    assert np.mean([r.predicted == r[name] for r in held]) >= least


def test_language(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    got = langid.identify(read("pages"), read("documents")).collect()
    assert len(got) == read("pages").count() and np.mean([r.lang == r.declared for r in got]) > 0.95


def test_empty_and_odd_tables(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for table in (docs, empty):
        n = table.count()
        assert pu_quality.classify(table, labels).count() == n
        assert toxgrammar.score_texts(table, labels).count() == n
        assert hyperminhash.near_duplicates(table.limit(n)).count() == n
        assert licences.scan(table).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert pagediff.main_text(pages).count() == langid.identify(pages, empty).count() == 0
    assert decontaminate.leaks(docs, bench).count() == decontaminate.leaks(empty, bench).count() == 0
    assert packing.pack(packing.token_pieces(empty, PATH)).count() == paragraphs.duplicate_spans(empty).count() == 0
    assert ledger.ledger(empty).count() == 0


def test_passages_in_short_lines_against_brute_force(spark):
    r, made, want = random.Random(11), [], {}
    for k in range(60):
        # a 51-word passage, its lines broken elsewhere in the second text
        passage = prose(1000 + k, 51).split()
        for side in (0, 1):
            w = [*prose(2000 + 2 * k + side, 40).split(), *passage, *prose(3000 + 2 * k + side, 40).split()]
            width = r.choice((8, 10, 12))
            made.append((2 * k + side, "\n".join(" ".join(w[i : i + width]) for i in range(0, len(w), width))))
        want[2 * k + 1] = (40, 51)
    # brute force: the shared run of each pair is the passage, or longer by chance
    for k in range(60):
        a, b = (words(made[2 * k + side][1]) for side in (0, 1))
        from_, n = want[2 * k + 1]
        while a[from_ - 1] == b[from_ - 1]:
            from_, n = from_ - 1, n + 1
        while a[from_ + n] == b[from_ + n]:
            n += 1
        want[2 * k + 1] = (from_, n)
    table = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    got = [x for x in paragraphs.passages(table).collect() if x.removed]
    assert {x.doc_id: (x.first_word, x.n_words) for x in got} == want and len(got) == len(want)
    texts = dict(made)
    for x in got:
        span = texts[x.doc_id].encode()[x.byte_from : x.byte_to].decode().split()
        assert span == texts[x.doc_id].split()[x.first_word : x.first_word + x.n_words]


def test_leaks_of_several_copies(spark):
    item = "A train leaves Rome at 9 with 120 seats and travels 300 km in 4 hours before Anna boards it near the old bridge"
    copy = lambda a, b, c: item.replace("120", a).replace("300", b).replace("Anna", c)
    made = [
        (1, " ".join([prose(21), copy("85", "410", "Peter"), copy("77", "95", "Maria"), prose(22)])),
        (2, " ".join([copy("66", "12", "Olga"), prose(23), copy("52", "71", "Ines"), prose(24), copy("31", "8", "Hugo")])),
        (3, " ".join([copy("85", "410", "Peter"), prose(25), item])),
        (4, " ".join([prose(26), copy("85", "410", "Peter").replace("old bridge", "old stone bridge")])),
    ]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r.kind for r in decontaminate.leaks(spark.createDataFrame(made, "doc_id long, text string"), bench).collect()}
    assert got == {1: "reparameterised", 2: "reparameterised", 3: "verbatim", 4: "reparameterised"}


def least_bins(lengths, size):
    """Martello and Toth's L2 bound: no packing needs fewer bins."""
    best = 0
    for k in range(size // 2 + 1):
        large = sum(x > size - k for x in lengths)
        middle = [x for x in lengths if size - k >= x > size / 2]
        small = sum(x for x in lengths if size / 2 >= x >= k)
        best = max(best, large + len(middle) + max(0, -(-(small - (len(middle) * size - sum(middle))) // size)))
    return best


@pytest.mark.parametrize("seed", range(6))
def test_plan_comes_close_to_the_bound(seed):
    r = random.Random(seed)
    lengths = [min(2048, 1 + int(r.lognormvariate(5 + seed / 3, 1))) for _ in range(3000)]
    counts = {x: lengths.count(x) for x in set(lengths)}
    lines = packing.plan(counts)
    used = {}
    for bin_, times in lines:
        assert sum(bin_) <= 2048
        for x in bin_:
            used[x] = used.get(x, 0) + times
    assert used == counts
    assert sum(times for _, times in lines) <= least_bins(lengths, 2048) + 1
