"""Operators against brute force, edge rows included."""
import hashlib
import itertools
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spanline.llm import common, decontaminate, exact_dedup, html, language, licenses, mixing, quality, simhash, substrings, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, id string"


def docs(spark, texts, **kw):
    """Rows with ids 0, 1, ... and columns whose names clash with the operators' own."""
    return spark.createDataFrame([(k, t, kw.get("lang", [None] * len(texts))[k], kw.get("source", [None] * len(texts))[k], 0, 1, "x") for k, t in enumerate(texts)], SCHEMA)


def find(n, edges):
    p = list(range(n))
    for a, b in edges:
        x, y = p[a], p[b]
        p = [min(x, y) if q in (x, y) else q for q in p]
    return p


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(3)
    words = ["".join(rng.choices(["the", "an", "er", "in", "on", "ti", "sh"], k=rng.randint(1, 3))) for _ in range(300)]
    return lambda n, seed: " ".join(random.Random(seed).choices(words, k=n))


def test_exact_dedup(spark, prose):
    long = prose(3000, 1)
    texts = [None, "", " ", "a b", "a\n\tb", long, long + "x", long.replace(" ", "\n"), "y" + long, *["same"] * 5, prose(2000, 2)]
    d = docs(spark, texts)
    d = d.union(d.where("doc_id = 9"))
    got = exact_dedup.exact_groups(d, block=64).collect()
    norm = {k: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for k, t in enumerate(texts)}
    groups = defaultdict(list)
    for k, t in [*norm.items(), (9, norm[9])]:
        groups[t].append(k)
    want = Counter()
    for t, ids in groups.items():
        for q, k in enumerate(sorted(ids)):
            want[(k, min(ids), len(ids), q == 0, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter(map(tuple, got)) == want
    assert exact_dedup.exact_groups(d.where("false")).count() == 0


def test_exact_dedup_hot_block(spark):
    got = exact_dedup.exact_groups(docs(spark, ["hot " * 40] * 400 + [f"t{k}" for k in range(30)]), block=64).collect()
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id < 400} == {(0, 400)} and sum(r.kept for r in got) == 31


def test_simhash(spark, prose):
    base = prose(60, 5)
    texts = [None, "", "One", "a b", "A b", base, base + " end", *[prose(40, k) for k in range(10)], *[base.replace("the", "teh", k) for k in range(6)]]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_groups(docs(spark, texts)).collect()}

    def slow(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        s = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    fps = [slow(t) for t in texts]
    comp = find(len(fps), [(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 3])
    assert got == {k: (f"{f:016x}", c) for k, (f, c) in enumerate(zip(fps, comp))}
    assert simhash.near_groups(docs(spark, ["x"]).where("false")).count() == 0


def test_simhash_links_lose_nothing(spark):
    rng = random.Random(9)
    fps = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
    fps = sorted(fps)
    d = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    edges = simhash.links(d, tile=4).collect()
    at = {x: k for k, x in enumerate(fps)}
    un = lambda x: x % (1 << 64)
    assert all((un(e.a) ^ un(e.b)).bit_count() <= 3 for e in edges)
    got = find(len(fps), [(at[un(e.a)], at[un(e.b)]) for e in edges])
    assert got == find(len(fps), [(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 3])


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.label for r in common.components(e).collect()}
    assert got == {**{k: 0 for k in range(31)}, 100: 100, 101: 100}


def test_mixing(spark, prose):
    texts = [prose(k % 17, k) for k in range(120)] + [None, "", "one"]
    source = ["a" if k % 3 else "b" for k in range(120)] + [None, "c", None]
    got = mixing.mix(docs(spark, texts, source=source)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs(spark, texts, source=source).repartition(3)).collect()))
    by = defaultdict(lambda: [0, 0, 0])
    for r in got:
        s = source[r.doc_id]
        by[s][0] += r.size
        by[s][1] += r.taken
        by[s][2] = r.target
        assert r.taken <= 3 * r.size and r.size == len((texts[r.doc_id] or "").split())
    assert all(int(t) == n for _, n, t in by.values())
    assert abs(sum(t for _, _, t in by.values()) - sum(n for n, _, _ in by.values())) < 1e-6
    assert mixing.mix(docs(spark, ["x"]).where("false")).count() == 0


def test_mixing_without_ids(spark, prose):
    """Rows without an id and repeated ids take a source's budget too, each once in its order."""
    rows = [(None if k % 3 else k, prose(k % 7, k), "a" if k % 2 else "b") for k in range(150)] + [(6, prose(3, 1), "a")] * 4
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(d).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    for size in {r.source_size for r in got}:
        mine = [r for r in got if r.source_size == size]
        assert sum(r.size for r in mine) == size and sum(r.taken for r in mine) == int(mine[0].target)
        whole = int(mine[0].target) // size
        assert sum(whole * r.size < r.taken < (whole + 1) * r.size for r in mine) <= 1


def test_quality(spark, prose):
    texts = [prose(50, k) if k % 2 else " ".join(["%%%"] * 5 + [prose(1, k)] * 30) for k in range(90)] + [None, ""]
    labels = spark.createDataFrame([(k, int(k % 2), 0) for k in range(90)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs(spark, texts), labels).collect()
    assert len(got) == 92 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.held_out and r.doc_id < 90)
    assert {r.score for r in quality.classify(docs(spark, ["x"]), labels.where("false")).collect()} == {0.5}
    x = np.array([[0.0], [1.0]] * 20)
    w, _ = quality.fit(x, np.array([0, 1] * 20))
    assert w[0] > 0


def test_decontamination_of_stretches(spark, prose):
    items = [prose(59, 1000), prose(59, 1001)]
    ws = [x.split() for x in items]
    texts = [f"{prose(40, 2)} {' '.join(ws[0][10:50])} {prose(40, 3)}", f"{prose(9, 4)} {' '.join(ws[1][29:])} {prose(30, 5)}", f"{prose(30, 6)} {' '.join(ws[0][:9])} {prose(30, 7)}"]
    it = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs(spark, texts), it).collect()} == {(0, 0), (1, 1)}
    x = np.arange(30)
    assert decontaminate.stretch(x, x[12:], 15, 0.7) == 1 and decontaminate.stretch(x, x[18:], 15, 0.7) <= 0.8 and decontaminate.stretch(x, x[20:] + 90, 15, 0.7) == 0


def test_align_is_smith_waterman():
    def slow(a, b):
        h = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        return h.max() / (2 * len(a))

    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = rng.integers(0, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(1, 20))
        assert abs(decontaminate.align(a, b)[0] - slow(a, b)) < 1e-9


def test_decontamination(spark, prose):
    items = [prose(30, 1000 + k) for k in range(6)] + ["tiny item", None, ""]
    edited = items[1].split()
    edited[5] = edited[14] = edited[22] = "other"
    texts = [prose(80, 1), f"{prose(40, 2)}\n{items[0].upper()} {prose(40, 3)}", f"{prose(20, 4)} {' '.join(edited)} {prose(20, 5)}", None, "", items[2], " ".join(items[3].split()[:6]), items[0], "a TINY item!"]
    it = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    d = docs(spark, texts)
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(d.union(d.where("doc_id = 5")), it).collect()}
    assert got == {(1, 0), (2, 1), (5, 2), (7, 0), (8, 6)}
    old, decontaminate.BLOCK_GRAMS = decontaminate.BLOCK_GRAMS, 80
    try:
        assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, it).collect()} == got
    finally:
        decontaminate.BLOCK_GRAMS = old
    assert decontaminate.leaks(d.where("false"), it).count() == 0 and decontaminate.leaks(d, it.where("false")).count() == 0


def test_decontamination_against_whole_alignments(spark, prose):
    """Seeds and windows lose nothing that aligning every document with every item finds."""
    rng = random.Random(12)
    items = [prose(rng.randint(12, 60), 2000 + k) for k in range(8)]
    texts = []
    for k in range(60):
        words = prose(rng.randint(20, 120), 3000 + k).split()
        if k % 2:
            item = rng.choice(items).split()
            item = item[: rng.choice([len(item), len(item), len(item) // 2 + 3])]
            for _ in range(rng.choice([0, 0, 1, len(item) // 12, len(item) // 6])):
                p = rng.randrange(len(item))
                item[p : p + 1] = rng.choice([["other"], [], [item[p], "more"]])
            at = rng.randrange(len(words))
            words[at:at] = item
        texts.append(" ".join(words))
    want = set()
    for i, t in enumerate(texts):
        for q, it in enumerate(items):
            ids: dict = {}
            a, b = (np.array([ids.setdefault(w, len(ids)) for w in decontaminate.words(x)]) for x in (it, t))
            score, need = decontaminate.align(a, b)[0], decontaminate.covered(len(a))
            if score >= 0.7 or need <= len(a) and decontaminate.stretch(a, b, need, 0.7) >= 0.7:
                want.add((i, q))
    got = decontaminate.leaks(docs(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 15
    for r in got:  # the place is where words of the item start
        assert decontaminate.words(texts[r.doc_id])[r.start_word] in decontaminate.words(items[r.item_id])
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), n=5).collect()} <= want


def test_license_labels_against_every_place(spark):
    rng = random.Random(2)
    vocabulary = sorted({w for t in licenses.TEMPLATES for w in t[1].split()}) + ["word", "other"]
    texts = []
    for k in range(80):
        words = rng.choices(vocabulary, k=rng.randint(0, 30))
        for _ in range(k % 3):
            notice = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                notice[rng.randrange(len(notice))] = "changed"
            words += notice + rng.choices(vocabulary, k=3)
        texts.append(" ".join(words))
    ws = [t.split() for t in texts]
    df = Counter(w for x in ws for w in set(x))
    idf = lambda w: np.log((1 + len(texts)) / (1 + df[w])) + 1e-3
    got = {r.doc_id: r for r in licenses.scan(docs(spark, texts)).collect()}
    for k, x in enumerate(ws):
        labels, top = set(), 0.0
        for label, notice, phrases, _ in licenses.TEMPLATES:
            n = notice.split()
            rare = sorted(set(n), key=lambda w: (-idf(w), w))[: licenses.RARE_WORDS]
            whole = sum(idf(w) for w in n if w in rare)
            for a in range(-len(n), len(x)):
                at = lambda p, a=a, x=x: x[a + p] if 0 <= a + p < len(x) else None
                ok = all(any(n[o : o + len(ph)] == ph and all(at(o + j) == w for j, w in enumerate(ph)) for o in range(len(n))) for ph in (y.split() for y in phrases))
                share = sum(idf(w) for p, w in enumerate(n) if w in rare and at(p) == w) / whole
                if ok and share >= licenses.LEAST_SHARE:
                    labels.add(label)
                    top = max(top, min(1.0, share))
        assert got[k].labels == ",".join(sorted(labels)) and got[k].score == pytest.approx(top, abs=1e-5)


def test_licenses(spark):
    texts = [None, "", "x All Rights  Reserved. cc-by and CC BY 4, general public license", "Released under the MIT License", "the mit", "all rights all rights reserved", "Licensed under CC BY-NC 4.0.", "word " * 3000 + "cc by"]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, texts)).collect()}
    base = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
    for k, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        at = sorted((p, name) for ph, name in base for p in range(len(w)) if w[p : p + len(ph.split())] == ph.split())
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None)
        assert r.base_labels == ",".join(sorted({n for _, n in at})) and 0 <= r.score <= 1
    assert (got[3].labels, got[4].labels, got[6].labels) == ("mit", "", "cc-by,cc-by-nc-4.0")


def test_language(spark, prose):
    fr = lambda n, s: " ".join(random.Random(s).choices(["éau", "queux", "leçon", "père", "ouvrir", "chêne"], k=n))
    ru = lambda n, s: " ".join(random.Random(s).choices(["дом", "река", "слово"], k=n))
    texts = [f(40, k) for k in range(40) for f in (prose, fr, ru)] + [None, "", "123 !!", prose(60, 991) + " " + fr(20, 992)]
    lang = ["en", "fr", "ru"] * 40 + [None, None, None, None]
    got = {r.doc_id: r for r in language.identify(docs(spark, texts, lang=lang)).collect()}
    assert all(got[k].lang_pred == lang[k] for k in range(120))
    assert [got[k].lang_pred for k in (120, 121, 122)] == ["und"] * 3 and got[122].score == 0
    assert [s.lang for s in got[123].spans] == ["en", "fr"] and got[123].lang_pred == "en" and 0.5 < got[123].score < 1


def test_viterbi_shortcut_is_exact():
    rng = np.random.default_rng(2)
    model = (["a", "b"], rng.normal(0, 3, (3, language.BUCKETS, 2)).astype(np.float32), np.ones((len(language.SCRIPTS), 2), bool))
    for k in range(20):
        text = " ".join("".join(rng.choice(list("abcdef"), 3)) for _ in range(8))
        starts, ends, _, grams = language._units(text)
        score = sum(t[g] for t, g in zip(model[1], grams)).astype(float)
        e = np.array([score[s:x].sum(axis=0) for s, x in zip(starts, ends)])
        value = lambda p: sum(e[i, q] for i, q in enumerate(p)) - language.SWITCH * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731,B023
        path = [next(q for a, b, q in language.spans(text, model) if a <= s < b) for s in starts]
        assert value(path) == pytest.approx(max(map(value, itertools.product((0, 1), repeat=len(starts)))), abs=1e-4)


def test_viterbi_shortcut_is_exact_with_three_languages():
    rng = np.random.default_rng(3)
    mixed = 0
    for _ in range(60):
        model = (["a", "b", "c"], rng.normal(0, 1.5, (3, language.BUCKETS, 3)).astype(np.float32), np.ones((len(language.SCRIPTS), 3), bool))
        text = " ".join("".join(rng.choice(list("abcdef"), 3)) for _ in range(5))
        starts, ends, _, grams = language._units(text)
        score = sum(t[g] for t, g in zip(model[1], grams)).astype(float)
        e = np.array([score[s:x].sum(axis=0) for s, x in zip(starts, ends)])
        value = lambda p: sum(e[i, q] for i, q in enumerate(p)) - language.SWITCH * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731,B023
        path = [next(q for a, b, q in language.spans(text, model) if a <= s < b) for s in starts]
        mixed += len(set(path)) > 1
        assert value(path) == pytest.approx(max(map(value, itertools.product(range(3), repeat=len(starts)))), abs=1e-4)
    assert mixed


def test_viterbi_with_two_other_languages():
    """Stretches in A and B, and C the best language of the whole."""
    table = np.zeros((3, language.BUCKETS, 3), np.float32)
    _, _, _, grams = language._units("x y")
    table[0, grams[0][0]], table[0, grams[0][2]] = [7, -9, 0], [-9, 7, 0]
    got = language.spans("x y", (["a", "b", "c"], table, np.ones((len(language.SCRIPTS), 3), bool)))
    assert got == [(0, 1, 0), (2, 3, 1)]


def test_language_letters_above_the_first_plane():
    assert not len(language._units("\U0001F600 \U0001F680!")[0]) and len(language._units("\U00020000 \U0001F600")[0]) == 1


def test_html(spark):
    page = '<html><head><title>t</title><style>p{}</style></head><body><nav><li>menu</ul></nav><div class="ad">Buy</div><article><h1>Head &amp; more</h1><p>One <b>bo</b>ld\n text<br>next<p>Two &eacute;<aside>side</aside></p><div class="comments">no</div><form>f</form></article><footer>foot</footer><script>"<p>x</p>"</script>'
    pages = spark.createDataFrame([(1, "http://a.b/1", page, 9), (2, "http://a.b/2", page.replace("Two", "Three"), 9), (3, None, None, 9), (4, "bad", "<div><p>only & this</div>", 9), (5, "http://c/", "", 9)], "page_id long, url string, html string, host long")
    got = {r.page_id: r for r in html.extract(pages.union(pages.where("page_id = 1"))).collect()}
    assert got[1].text == "Head & more\n\nOne bold text next\n\nTwo é" and got[2].text.endswith("Three é")
    assert (got[3].text, got[5].text, got[4].text) == ("", "", "only & this") and all(r.n_chars == len(r.text) for r in got.values())


def test_wrapper_alignment():
    a, b = [["x", "", 1], ["y", "", 1], ["z", "", 1]], [["x", "", 2], ["z", "+", 2], ["w", "", 2]]
    assert html.align(a, b) == [["x", "", 3], ["y", "?", 1], ["z", "+", 3], ["w", "?", 2]]
    assert html.folded(["p", "p", "q"]) == [["p", "+"], ["q", ""]]


def test_alignment_is_a_longest_common_subsequence():
    def slow(a, b):
        if not a or not b:
            return 0
        return 1 + slow(a[1:], b[1:]) if a[0] == b[0] else max(slow(a[1:], b), slow(a, b[1:]))

    rng = random.Random(6)
    for _ in range(60):
        a, b = ("".join(rng.choices("abcd", k=rng.randint(0, 8))) for _ in range(2))
        best = html.suffixes(list(a), list(b))
        assert all(best(i, j) == slow(a[i:], b[j:]) for i in range(len(a) + 1) for j in range(len(b) + 1))
        slots = html.placed([[x, ""] for x in a], [[x, ""] for x in b])
        met = [(k, x) for x, k in enumerate(slots) if k >= 0]
        assert len(met) == slow(a, b) and met == sorted(met) and all(a[k] == b[x] for k, x in met)
        both = [x for x, _, _ in html.align([[x, "", 1] for x in a], [[x, "", 1] for x in b])]
        for x in (a, b):
            rest = iter(both)
            assert all(y in rest for y, _ in itertools.groupby(x))


def test_html_shares_of_a_host(spark, monkeypatch):
    """A host dealt in many shares, merged in several rounds, gives what one share does."""
    rows = [(k, f"http://h/{k}", f'<body><div class="top">Menu here</div><div class="b"><h2>Head {k}</h2>' + "".join(f"<p>Par {k} {j}</p><blockquote>q{k}{j}</blockquote>" for j in range(k % 9)) + '</div><div class="end">Terms apply</div></body>') for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = sorted(map(tuple, html.extract(pages).collect()))
    monkeypatch.setattr(html, "SHARE", 1)
    monkeypatch.setattr(html, "FAN", 2)
    assert sorted(map(tuple, html.extract(pages).collect())) == whole
    assert all("Menu" not in r[2] and "Terms" not in r[2] and f"Head {r[0]}" in r[2] for r in whole)


def test_html_hosts(spark):
    """Layouts side by side on a host."""
    rows = [("http://m/1", "<body><main><p>in main</p></main></body>"), ("http://m/2", "<body><div><p>plain page</p></div></body>"), (None, "<main><p>odd</p></main>"), ("bad", "<div><p>no main</p></div>")]
    pages = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string")
    assert [r.text for r in sorted(html.extract(pages).collect())] == ["in main", "plain page", "odd", "no main"]


def test_html_template_text(spark):
    """Template text without telling names, and names that a host overrules."""
    rows = [(f"http://t/{k}", f'<body><div class="x7">We use biscuits</div><div class="x1"><p>Story {k} of the day</p></div><div class="x9">Terms</div></body>') for k in range(5)]
    rows += [(f"http://o/{k}", f'<body><div class="content has-sidebar"><p>Long story {k} that varies and goes on</p><div class="ad">buy {k}</div></div><div class="ad">b{k}</div></body>') for k in range(5)]
    rows += [("http://e/1", "<body><div class='y'>Same</div></body>")] * 3
    pages = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string")
    got = [r.text for r in sorted(html.extract(pages).collect())]
    assert got[:5] == [f"Story {k} of the day" for k in range(5)]
    assert got[5:10] == [f"Long story {k} that varies and goes on" for k in range(5)]
    assert got[10:] == ["Same"] * 3


def test_html_reprints_keep_their_article(spark):
    """Pages of a host that share their whole article, any number of them; what pages that are otherwise unlike share still goes."""
    body = "".join(f"<p>Paragraph {k} of the one story that they all print.</p>" for k in range(6))
    rows = []
    for n in (2, 3, 8):
        for tag in ("div class='x2'", "article"):
            rows += [(f"http://{n}{tag[:3]}/{k}", f"<body><{tag}>{body}</{tag.split()[0]}><div class='x3'>Posted on day {k}.</div></body>") for k in range(n)]
    rows += [(f"http://mixed/{k}", f"<body><div class='x1'>We use biscuits on all of our pages</div><div class='x2'>{body if k < 3 else f'<p>Story {k}, told once at some length and nowhere else.</p>'}</div></body>") for k in range(12)]
    pages = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r.url: r.text for r in html.extract(pages).collect()}
    assert all(text.count("Paragraph") == 6 for url, text in got.items() if "mixed" not in url)
    assert all(got[f"http://mixed/{k}"].count("Paragraph") == 6 for k in range(3))
    assert all(got[f"http://mixed/{k}"] == f"Story {k}, told once at some length and nowhere else." for k in range(3, 12))


def test_html_odd_nesting_is_linear():
    n = 200_000
    for page in ("<b>" * n + "<p>x</p>" + "</i>" * n, "<div>a" * n, "<b><p>x" * n, "</div>" * n + "x", "<li><dt>a" * n, "<table>" + "<tr><td>a" * n):
        began = time.time()
        assert html.blocks(page)
        assert time.time() - began < 20
    assert [t for _, t in html.blocks("<p>a<b>b</p><p>c</b>d<div>e<i>f</i></div>g")] == ["ab", "cd", "ef", "g"]


def test_long_alignments_in_little_memory(monkeypatch):
    rng = random.Random(9)
    for size in (4, 1 << 24):
        monkeypatch.setattr(html, "TABLE", size)
        for _ in range(60):
            a, b = (rng.choices("abcde", k=rng.randint(0, 40)) for _ in range(2))
            m = html.matches(a, b)
            assert len(m) == html.suffixes(a, b)(0, 0) and all(a[i] == b[j] for i, j in m)
            assert all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(m))
    a, b = (rng.choices([str(k) for k in range(50)], k=20_000) for _ in range(2))
    began = time.time()
    assert len(html.matches(a, b)) > 2_000 and time.time() - began < 60


def test_what_the_wrappers_leave_out_is_template_by_its_path(spark):
    """A slot of three pages in four hundred, and a layout of three pages in some three thousand."""
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(12))
    rare = lambda k: "<section class='extra'>Read this on every page.</section><p>own {0}</p><section class='extra'>Read this on every page.</section>".format(words(f"b{k}")) if k < 3 else ""
    one = [(k, f"http://a.org/{k}", f"<body><div><p>{words(k)}</p></div>{rare(k)}</body>") for k in range(400)]
    odd = [(1000 + k, f"http://b.org/{k}", f"<body><dl><dd>{words(k)}</dd></dl><section><b>Ask the desk for more.</b></section></body>") for k in range(3)]
    two = [(2000 + k, f"http://b.org/x{k}", f"<body><div><p>{words(k)}</p></div></body>") for k in range(3200)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame([*one, *odd, *two], "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(3)] == [f"{words(k)}\n\nown {words(f'b{k}')}" for k in range(3)]
    assert [got[1000 + k] for k in range(3)] == [words(k) for k in range(3)]
    assert all(got[r[0]] == words(r[0] % 1000 if r[0] < 2000 else r[0] - 2000) for r in [*one[3:], *two])


def test_wrappers_do_not_grow_with_a_host():
    shape = lambda k: {"pages": 1, "slots": [["top", "", 1], [f"only{k}", "", 1], ["end", "", 1], ["foot", "", 1]]}
    w = html.clustered([shape(k) for k in range(400)])
    assert [x[0] for x in w[0]["slots"]] == ["top", "end", "foot"] and w[0]["pages"] == 400
    assert len(html.clustered([shape(k) for k in range(100)])[0]["slots"]) == 103
    assert len(html.clustered([{"pages": 1, "slots": [[f"a{k}", "", 1]]} for k in range(3000)] + [{"pages": 50, "slots": [["b", "", 50]]}])) == 1


def test_tokens(spark):
    tk = pytest.importorskip("tokenizers")
    pieces = tokens.load()
    ref = tk.models.Unigram([("<unk>", 0.0), *pieces], 0, False)
    c = tokens.Counter(pieces, byte_fallback=False)
    rng = random.Random(4)
    for k in range(300):
        w = "▁" + "".join(rng.choices("abcdeiountrsh" + "éß" * (k % 2), k=rng.randint(1, 18)))
        assert c.word(w) == len(ref.tokenize(w)), w
    got = tokens.count(docs(spark, [None, "", "hello world", "日\n"])).collect()
    assert [r.n_tokens for r in sorted(got)][:2] == [0, 0]


def test_tokens_of_whole_texts():
    tk = pytest.importorskip("tokenizers")
    pieces = tokens.load()
    ref = tk.models.Unigram([("<unk>", 0.0), *pieces, *[(f"<0x{b:02X}>", 0.0) for b in range(256)]], 0, True)
    c = tokens.Counter(pieces)
    assert c.text("a    b") == 3
    rng = random.Random(5)
    for _ in range(300):
        t = "".join(rng.choices(["the", "if", "x", "(", "é", "日本", "\n", "▁", " ", "  ", "    ", "        "], k=rng.randint(1, 14)))
        assert c.text(t) == len(ref.tokenize("▁" + t.replace(" ", "▁"))), t


def test_substrings(spark, prose):
    p, q = prose(60, 1), prose(70, 2)
    near = p.split()
    near[30] = "changed"
    texts = [f"{prose(30, 11)}\n{p}\n{prose(20, 12)}", f"{p}\nshort line", f"{prose(30, 13)}\n\n{' '.join(near)}", prose(80, 14), f"{q[:200]}\n{q[200:]}\nend", f"x\n{q[:200]}\n\n{q[200:]}", "short line", None, ""]
    d = docs(spark, texts)
    got = sorted((r.doc_id, r.first_par, r.last_par, r.keep_id) for r in substrings.repeats(d.union(d)).collect())
    assert got == [(1, 0, 0, 0), (2, 2, 2, 0), (5, 1, 3, 4)]
    b, r = substrings.tune()
    assert 1 - (1 - 0.8**r) ** b >= 0.995
    assert substrings.repeats(d.where("false")).count() == 0


def test_substrings_inside_lines(spark):
    """Passages of 51 words and more anywhere in unlike lines, against all runs of 50 words."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(1, 5))) for _ in range(400)]
    some = lambda n: rng.choices(words, k=n)
    planted = [some(rng.choice([51, 52, 60, 90])) for _ in range(12)]
    texts = []
    for k in range(60):
        body = some(rng.randint(0, 150))
        for p in rng.sample(planted, rng.choice([0, 0, 1, 2])):
            body += some(14) + p[: rng.choice([30, 49, len(p), len(p)])] + some(rng.randint(14, 150))
        texts.append(rng.choice([" ", ", ", "\n"]).join(body))
    copied = next(t for t in texts if t.count("\n") > 60)
    texts += [None, "", copied, "the " * 120, "The " * 70]
    d = docs(spark, texts)
    got = substrings.repeats(d.union(d.where("doc_id % 3 = 0"))).collect()
    ws = [re.findall(r"\w+", (t or "").lower()) for t in texts[:-2]]
    first, want = {}, defaultdict(set)
    for k, w in enumerate(ws):
        for q in range(len(w) - 49):
            if first.setdefault(tuple(w[q : q + 50]), k) != k:
                want[k] |= set(range(q, q + 50))
    have = defaultdict(set)
    for r in got:
        have[r.doc_id] |= set(range(r.first_word, r.first_word + r.n_words))
        assert r.keep_id < r.doc_id and r.n_words >= 50
    assert want and dict(have) == dict(want)
    par = next(r for r in got if r.doc_id == 62)
    assert (par.first_par, par.last_par) == (0, copied.count("\n"))


@pytest.mark.parametrize("one", [False, True])
def test_substrings_pieced_together(spark, prose, one):
    """Thirty words each of a stretch, in as many documents or in one but elsewhere, are no copy of it."""
    whole = prose(120, 21).split()
    pieces = [" ".join(whole[k : k + 30]) for k in range(0, 96, 18)]
    texts = [" ".join(f"{prose(20, 50 + k)} {x}" for k, x in reversed(list(enumerate(pieces))))] if one else [f"{prose(20, 30 + k)} {x} {prose(20, 40 + k)}" for k, x in enumerate(pieces)]
    assert substrings.repeats(docs(spark, [*texts, f"{prose(10, 60)} {' '.join(whole)}"])).count() == 0
    # A later copy of the whole is one, whatever its pieces' first documents are.
    got = substrings.repeats(docs(spark, [*texts, f"{prose(10, 60)} {' '.join(whole)}", f"{prose(14, 61)} alone {' '.join(whole)} {prose(5, 62)}"])).collect()
    assert [(r.doc_id, r.first_word, r.n_words) for r in got] == [(len(texts) + 1, 15, 120)]


def test_window_hashes(spark):
    rng = np.random.default_rng(3)
    h = rng.integers(0, 9, 400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x, y = substrings.windows(h, np.arange(400), 3), substrings.windows(np.concatenate((h[:7], h)), np.arange(407), 3)
    assert (y[7:] == x).all() and (x[-2:] == 0).all() and not len(substrings.windows(h[:0], np.zeros(0, int), 3))
    at = {}
    for k in range(398):
        assert at.setdefault(tuple(h[k : k + 3]), x[k]) == x[k]
    assert len(set(at.values())) == len(at)


def test_substrings_ids(spark, prose):
    """Null ids and ids that texts share are told apart by text; a passage that repeats in one document stays."""
    p, q = prose(70, 1), prose(60, 2)
    rows = [(None, f"{prose(9, 3)} {p}"), (None, f"{prose(8, 4)} {p} {prose(5, 5)}"), (7, f"{q} {prose(5, 6)}"), (7, f"{prose(5, 7)} {q}"), (8, f"{prose(66, 8)} and {prose(66, 8)}")]
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, dk string")
    got = substrings.repeats(d).collect()
    assert sorted((str(r.doc_id), r.n_words, str(r.keep_id)) for r in got) == [("7", 60, "7"), ("None", 70, "None")] and len({r.cluster_id for r in got}) == 2


def test_pipeline(spark, prose, tmp_path):
    import corpus_pipeline

    good = [prose(60, k) for k in range(40)]
    bench = prose(30, 777)
    texts = [*good, *["%%% " * 30 + prose(3, k) for k in range(40)], good[0], good[1] + "  ", good[2] + " " + bench]
    docs(spark, texts, source=["s"] * len(texts)).drop("fp", "id").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k < 40), 0) for k in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert out == set(range(40))


def test_pipeline_stages_with_odd_rows(spark, prose, tmp_path):
    import corpus_pipeline

    bench = prose(30, 777)
    spark.createDataFrame([(0, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "a b"), (1, "a b"), (1, "other"), (2, "a  b"), (None, "a b"), (None, "alone"), (3, None), (4, ""), (None, bench), (5, bench)]
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, id string")
    got = corpus_pipeline.drop_copies(spark, d, str(tmp_path))
    assert got.columns == d.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(1, "a b"), (1, "other"), (None, "alone"), (3, None), (5, bench)])
    got = corpus_pipeline.drop_leaks(spark, d, str(tmp_path))
    assert got.columns == d.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(rows[:8])
    empty = d.where("false")
    assert corpus_pipeline.drop_copies(spark, empty, str(tmp_path)).count() == corpus_pipeline.drop_leaks(spark, empty, str(tmp_path)).count() == 0


def test_near_dedup_stage_with_odd_rows(spark, prose, tmp_path):
    import corpus_pipeline

    a, b, c = prose(200, 1), prose(200, 2), prose(200, 3)
    near = next(x for k in range(200) for x in [" ".join([*a.split()[:k], "changed", *a.split()[k + 1 :]])] if (simhash.simhash(x) ^ simhash.simhash(a)).bit_count() <= 3)
    drop = lambda rows: Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near(spark, spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, id string"), str(tmp_path)).collect())
    assert drop([(1, a), (5, near), (5, b)]) == Counter([(1, a), (5, b)])
    got = drop([(1, a), (1, near), (None, c), (None, f"{c} "), (2, b), (2, b)])
    assert sorted(Counter(k for k, _ in got.elements()).items(), key=str) == [(1, 1), (2, 1), (None, 1)]
    assert drop([(None, a), (7, near), (None, None), (8, "")]) == Counter([(7, near), (8, "")])
    assert not drop([])


def test_marks_are_no_letters(spark):
    train = [("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 4
    rows = [(k, t, x) for k, (t, x) in enumerate(train)] + [(100, "\u0301", None), (101, "\u2764\ufe0f", None), (102, "1\ufe0f\u20e3 2\ufe0f\u20e3", None), (103, "\u0301the\u0301 cat \u0301", None), (104, "\u0130the cat", None)]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all((got[k].lang_pred, got[k].score, got[k].spans) == ("und", 0.0, []) for k in (100, 101, 102))
    assert got[103].lang_pred == "en" and [(s.start, s.end) for s in got[103].spans] == [(1, 9)]
    assert [(s.start, s.end) for s in got[104].spans] == [(0, 8)]
