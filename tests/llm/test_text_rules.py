from __future__ import annotations

import hashlib
import random
import re
import time
from collections import defaultdict

import pytest

from cuewright.llm import decontamination as dc
from cuewright.llm import licenses as lc
from cuewright.llm import page_text as pt
from cuewright.llm.common import words

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, window=10):
    wins = defaultdict(set)
    for item, text in items:
        w = WORD.findall(lower(text))
        n = min(len(w), window)
        for k in range(len(w) - n + 1 if w else 0):
            wins[tuple(w[k : k + n])].add(item)
    out = []
    for doc, text in docs:
        w, hit, found = WORD.findall(lower(text)), set(), set()
        for n in {len(k) for k in wins}:
            for k in range(len(w) - n + 1):
                if got := wins.get(tuple(w[k : k + n])):
                    found |= got
                    hit |= set(range(k, k + n))
        names = ",".join(sorted(str(i) for i in found))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(5)
    vocabulary = ["alpha", "beta", "gamma", "Delta", "épsilon", "zeta", "eta9"]
    items = [(k, " ".join(rng.choices(vocabulary, k=n))) for k, n in enumerate([12, 15, 10, 3, 2, 1, 9, 30])] + [(20, None), (21, ""), (22, "Zeta!"), (3, "beta gamma delta twice-named")]
    items.append((30, items[0][1]))
    docs = []
    for k in range(60):
        w = rng.choices(vocabulary, k=rng.randint(0, 80))
        if k % 3 == 0:
            w[5:5] = (rng.choice(items)[1] or "").split()
        docs.append((k, rng.choice([" ", ", ", "--"]).join(w)))
    docs += [(100, None), (101, ""), (None, items[0][1]), (5, docs[5][1])]
    for k, (_, t) in enumerate(items[:3]):
        docs.append((200 + k, f"clean words {t.upper()} more clean"))
    return docs, items


@pytest.mark.parametrize("block_words", [2_000_000, 8])
def test_contamination_equals_brute_force(spark, planted, block_words):
    docs, items = planted
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, h string")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = dc.find_contamination(d, b, block_words=block_words)
    rows = [(r["doc_id"], r["n_words"], r["n_hit"], len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r["n_hit"] > 0) for r in found.collect()]
    want = brute(docs, items)
    assert sorted(rows, key=str) == want


def test_contamination_of_awkward_rows(spark, awkward, nothing):
    b = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven")], "item_id long, text string")
    rows = {(r["doc_id"], r["n_words"], r["n_hit"], r["contaminated"]) for r in dc.contamination_digest(awkward, b).collect()}
    assert {(1, 12, 10, True), (2, 12, 10, True), (3, 0, 0, False), (4, 0, 0, False), (7, 1, 0, False)} <= rows
    assert dc.contamination_digest(awkward, b).count() == awkward.count()
    assert dc.contamination_digest(nothing, b).count() == 0
    assert not dc.contamination_digest(awkward, b.limit(0)).filter("contaminated").count()


def test_decontaminate(spark, awkward):
    item = "two three four five six seven eight nine ten eleven"
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    filler = " ".join(f"clean{k}" for k in range(20))
    d = spark.createDataFrame([(1, f"{filler} {item.title()}, {filler}", 9, "a"), (2, f"x {item} y", 8, "b"), (3, filler, 7, "c"), (4, None, None, "d")], "doc_id long, text string, n_chars long, h string")
    rows = {r["doc_id"]: r for r in dc.decontaminate(d, b).collect()}
    assert set(rows) == {1, 3, 4}
    assert rows[1]["text"] == f"{filler} , {filler}" and rows[1]["n_chars"] == len(rows[1]["text"]) and rows[1]["h"] == "a"
    assert rows[3]["n_chars"] == 7 and rows[4]["text"] is None
    assert dc.decontaminate(awkward, b).columns == awkward.columns


def test_blocks_of_items_change_no_row(spark, awkward):
    """Repeated rows, and null and empty texts of one id, come out each, and cuts and drops are those of one block."""
    rng = random.Random(8)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(12))) for k in range(12)]
    runs = [" ".join(f"i0w{j}" for j in range(12)), " ".join(f"i0w{j}" for j in range(4, 12)) + " o1 o2 o3 o4"]
    items += [(20, runs[1]), (21, "o1 o2 o3 o4 " + " ".join(f"p{j}" for j in range(8)))]
    filler = lambda n: " ".join(f"f{rng.randrange(999)}" for _ in range(n))
    rows = [(1, None), (1, ""), (2, "same text"), (2, "same text"), (3, f"{filler(30)} {runs[0]} o1 o2 o3 o4 " + " ".join(f"p{j}" for j in range(8)))]
    for k in range(40):  # hit a third by each of two items
        a, b = rng.sample(range(12), 2)
        rows.append((100 + k, f"{items[a][1]} {filler(12)} {items[b][1]}"))
        rows.append((200 + k, f"{items[a][1]} {filler(30)} {items[b][1]}"))
    d = spark.createDataFrame([(*r, len(r[1] or ""), "x") for r in rows], "doc_id long, text string, n_chars long, Spans string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = [[sorted(map(tuple, f(d, b, block_words=n).collect()), key=str) for f in (dc.find_contamination, dc.decontaminate)] for n in (2_000_000, 40)]
    assert got[0] == got[1]
    assert len(got[1][0]) == len(rows) and not {r[0] for r in got[1][1]} & set(range(100, 140)) and {r[0] for r in got[1][1]} >= set(range(200, 240))
    many = dc.decontaminate(awkward, b, block_words=40)
    assert many.columns == awkward.columns and many.count() == awkward.count()


def test_repeated_short_and_long_items_equal_brute_force(spark):
    """Equal items, items of one word and of one repeated word, and items longer than a block, for any block size."""
    rng = random.Random(4)
    vocabulary = [f"v{k}" for k in range(6)]
    same = "the same ten words or more of an item that repeats"
    items = [(k, same) for k in range(30)] + [(7, same)] * 5 + [(40, "solo"), (41, "solo"), (42, "pair of"), (43, "v0 " * 60), (44, "v0 v0 v0"), (None, "null id words here")]
    items += [(50, " ".join(rng.choices(vocabulary, k=200))), (51, None), (52, "")]
    docs = [(k, " ".join(rng.choices([*vocabulary, "solo", "pair", "of", "x"], k=rng.choice([0, 5, 60, 300])))) for k in range(30)]
    docs += [(100, f"x {same} y solo"), (101, "v0 " * 150), (102, items[-3][1]), (103, " ".join(items[-3][1].split()[50:70])), (104, "null id words here")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, [i for i in items if i[0] is not None])
    for block_words in (2_000_000, 30):
        rows = [(r["doc_id"], r["n_words"], r["n_hit"], len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r["n_hit"] > 0) for r in dc.find_contamination(d, b, block_words=block_words).collect()]
        assert sorted((r for r in rows if r[0] != 104), key=str) == [w for w in want if w[0] != 104]
        assert [r[1:4] for r in rows if r[0] == 104] == [(4, 4, 0)]


def test_matching_is_linear_in_the_text():
    def seconds(items, n):
        m, began = dc.ItemMatcher(items, 10), time.process_time()
        m.match([b"w", b"x"] * (n // 2) if len(items[0][1]) < 100 else [b"w"] * n)
        return time.process_time() - began

    ten = b"one two three four five six seven eight nine ten"
    for items in ([(("1",), ten), (("2",), b"w")], [(("1",), b"w " * 4_000), (("2",), b"w w w")]):
        assert seconds(items, 40_000) < 1.5


def test_license_places_equal_brute_force(spark, awkward, nothing):
    texts = ["Under the MIT License. under the mit-license", "Apache License, Version 2.0 and CC BY-NC 4.0", "cc by", None, "", "under the mit"] + ["mit " * 5]
    d = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, labels int")
    for r in lc.scan_licenses(d).collect():
        w = WORD.findall(lower(texts[r["doc_id"]]))
        places = sorted((k, label) for p, label in lc.BASE_PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        at = [k for k, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
    assert lc.scan_licenses(awkward).count() == awkward.count() and lc.scan_licenses(nothing).count() == 0


def test_templates():
    scan = lambda t: [(a, b, label) for a, b, label, _ in lc.LicenseScanner().scan(words(t.encode()))[1]]
    assert scan("This work is licensed under the GNU General Public License, version 3.")[0][2] == "gpl-3"
    assert not scan("This work is licensed under the GNU Public License, version 3.")  # mandatory wording is missing
    a = lc.TemplateAutomaton("copyright ((c)) <<2>> by [[me|my company]] end")
    for text, end in [("copyright by me end", 4), ("copyright c 2020 x by my company end", 8), ("copyright 1 2 3 by me end", 0), ("copyright by my end", 0)]:
        assert a.accepts(words(text.encode()), 0) == end
    with pytest.raises(ValueError, match="unbalanced|closed"):
        lc.TemplateAutomaton("a ((b")
    for crossed in ("a ((b]]", "a [[b))", "a [[b ((c]] d))", "a ((b [[c)) d]]"):
        with pytest.raises(ValueError, match="own mark|unbalanced"):
            lc.TemplateAutomaton(crossed)
    mit = next(t for label, weight, t in lc.TEMPLATES if label == "mit" and weight == 1.0)
    whole = "Copyright 2020 A. B.\n" + mit.replace("((including the next paragraph))", "").replace("[[authors or copyright holders|copyright holders or authors|authors|copyright holders]]", "AUTHORS OR COPYRIGHT HOLDERS")
    scores = [max(w for *_, w in lc.LicenseScanner().scan(words(t.encode()))[1]) for t in (whole, whole.replace("noninfringement", "infringement"))]
    assert scores == [1.0, 0.9]


@pytest.fixture(scope="module")
def chain():
    return pt.train_chain(pt.labelled_pages(250))


def test_chain_on_held_out_pages(chain):
    right = total = 0
    for page in pt.labelled_pages(80, seed=99):
        labels = chain.decode(f for f, _ in page)
        right += sum(a == b for a, (_, b) in zip(labels, page, strict=True))
        total += len(page)
    assert right / total > 0.99


def test_only_what_is_dropped_is_dropped():
    """Open and self-closed elements do not take the rest of the page with them."""
    texts = lambda page: [t for t, _ in pt.blocks(page)]
    assert texts("<html><head><title>t</title><body><article><p>Main text.") == ["Main text."]
    assert texts("<head><meta a=b><script>var x = '</head>'</script><p>One.</p></head><p>Two.") == ["One.", "Two."]
    assert texts("<html><head><title>t</title></head><body><header>One.</header><p>Two.") == ["One.", "Two."]
    for tail in ("", "<svg><text>x</text></svg>"):
        assert texts('<p>One.</p><svg viewBox="0 0 1 1"/><p>Two.</p>' + tail) == ["One.", "Two."]
    assert texts("<p>One.</p><svg><style/><svg/><text>x</text></svg><p>Two.") == ["One.", "Two."]
    for tag in ("svg", "math", "object", "select", "video", "audio", "canvas", "template", "noscript"):
        assert texts(f"<p>One.</p><{tag}><p>Two.</p>") == ["One.", "Two."]
        assert texts(f"<p>One.</p><{tag}><b>x</b><p>y</p></{tag}><p>Two.</p>") == ["One.", "Two."]
    assert texts("<p>One.</p><video><p>Two.</p><video>x</video><p>Three.") == ["One.", "Two.", "Three."]
    assert texts("<p>One.</p><script>if (a < b) x()") == ["One."]


def test_elements_below_any_depth_count():
    inside = lambda page: {t: {f for f in fs if f.startswith("in:")} for t, fs in pt.blocks(page)}
    got = inside("<article>" + "<div>" * 250 + "deep" + "</div>" * 250 + "<p>later</p></article><footer>end</footer>")
    assert got == {"deep": {"in:article", "in:div"}, "later": {"in:article", "in:p"}, "end": {"in:footer"}}
    assert "in:footer" in inside("<section>" * 300 + "text<footer>end</footer>")["end"]


def test_tags_that_are_written_badly():
    """Quotes count where a value begins and are closed; a tag without an end takes no more than what stands up to the next one."""
    text = lambda page: " ".join(t for t, _ in pt.blocks(page))
    assert text("<article><p data-x=it's>First</p><p>It's the second</p></article>") == "First It's the second"
    assert text('<article><p title="oops>First</p><p>Second</p></article>') == "First Second"
    assert text('<p a="1>2" b = \'x>y\' c=z>First</p><p>Second') == "First Second"
    assert text("<p>First</p><p class=x second <p>Third</p> 1 < 2 <b unended") == "First Third 1 < 2"
    assert text('<p>First</p><a x=">" <b y=">" <i><p>Second</p><p z=">"') == "First Second"
    nested = "<div>" * 300 + "<p>Deep</p>" + "</div>" * 300 + "<p>After</p>"
    assert text(nested) == "Deep After"


@pytest.mark.parametrize("unit", ['<a "', "<a x='", "<!", "<a <", '<p x=">" ', "</", "<script", "<head <", "&lt;<"])
def test_bad_pages_take_linear_time(unit):
    began = time.process_time()
    pt.blocks(unit * (1_000_000 // len(unit)))
    pt.blocks(unit * (1_000_000 // len(unit)) + ">")
    assert time.process_time() - began < 6  # seconds for two megabytes


def test_viterbi_finds_the_best_labelling():
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(20):
        c = pt.Chain({"a": float(rng.normal()), "b": float(rng.normal())}, float(rng.normal()), rng.normal(size=(2, 2)), rng.normal(size=2))
        fs = [[["a"], ["b"], ["a", "b"], []][k] for k in rng.integers(0, 4, size=6)]

        def score(y):
            gain = [c.bias + sum(c.weights[x] for x in f) for f in fs]
            return c.start[y[0]] + sum(g for g, v in zip(gain, y, strict=True) if v) + sum(c.step[p][q] for p, q in zip(y, y[1:], strict=False))

        assert score(c.decode(fs)) == pytest.approx(max(score(y) for y in itertools.product((0, 1), repeat=6)))


def test_pages(spark, chain):
    page = (
        "<html><head><title>T</title><script>var x='<p>no</p>'</script></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav>"
        '<div class="cookie-notice"><p>We use cookies, please agree to all of them.</p></div><article><h1>Title &amp; more</h1><p>First  paragraph\n with <b>bold</b>text&nbsp;here, and long enough.'
        '<p>Second paragraph of the article, which goes on.</p><div class="ad">Buy now!</div></article>'
        '<section class="comments"><p>I liked this article very much, thanks for it.</p></section><footer>&copy; 2020 Someone</footer></body></html>'
    )
    rows = [(1, "u", page, "x"), (2, None, None, "x"), (3, "v", "", "x"), (4, "w", "<p>unclosed", "x"), (None, "z", "<div><" * 300, "x"), (1, "u", page, "x")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = pt.extract_text(d, chain=chain).collect()
    assert len(got) == len(rows)
    want = "Title & more First paragraph with boldtext here, and long enough. Second paragraph of the article, which goes on."
    assert [r["text"] for r in got if r["page_id"] == 1] == [want, want]
    assert all(r["n_chars"] == len(r["text"]) for r in got) and [r["text"] for r in got if r["page_id"] in (2, 3)] == ["", ""]
    assert pt.extract_text(d.limit(0), chain=chain).count() == 0


def test_little_is_kept_of_many_different_pages():
    """Start tags that never come again leave nothing but the entries of bounded caches."""
    page = lambda k: f"<html><body class='postid-{k}'><article>" + "".join(f"<div class='content c{k}-{j}' data-x='{'y' * 500}'><p id='p{k}-{j}'>text {j} of the article.</p></div>" for j in range(40)) + "</article></body></html>"
    first = [f for _, f in pt.blocks(page(0))]
    for k in range(800):
        assert len(pt.blocks(page(k))) == 40
    assert [sorted(f) for f in first] == [sorted(f) for _, f in pt.blocks(page(1))]
    for cache in (pt._own_features, pt._joined, pt._inside):
        assert cache.cache_info().currsize <= cache.cache_info().maxsize <= 20_000


def test_copyright_is_seen_anywhere_in_a_block():
    filler = "word " * 100
    assert "copyright" in pt.blocks(f"<p>{filler}Copyright held by someone</p>")[0][1] and "copyright" not in pt.blocks(f"<p>{filler}</p>")[0][1]
