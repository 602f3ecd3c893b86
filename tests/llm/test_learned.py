"""Extraction on generated hosts and the pairwise fit, against brute force."""
import random

import numpy as np
from pyspark.sql import functions as F

from spanline.llm import html, quality


def host_pages(rng, host):
    """Pages of one layout whose blocks have names that tell nothing: some the same on most pages, some told once."""
    names = [f"z{k}" for k in range(7)]
    same = {n: " ".join(f"{host}{n}w{k}" for k in range(rng.randint(1, 5))) for n in rng.sample(names, rng.randint(1, 4))}
    copies = [" ".join(f"{host}c{q}w{k}" for k in range(40)) for q in range(2)]
    pages = []
    for k in range(rng.choice([2, 4, 9])):
        page = []
        for n in names:
            if rng.random() < 0.15:
                continue
            own = copies[k % 2] if n == "z6" and rng.random() < 0.4 else " ".join(f"{host}{k}{n}w{j}" for j in range(rng.randint(1, 12)))
            page.append((n, same[n] if n in same and rng.random() < 0.9 else own))
        pages.append(page)
    return pages


def slow(pages):
    """The text of each page of one host."""
    distinct = [p for k, p in enumerate(pages) if p not in pages[:k]]
    having = lambda n: sum(any(m == n for m, _ in p) for p in distinct)
    on = lambda b: [p for p in distinct if b in p]
    shared = {b for p in distinct for b in p if len(on(b)) >= 3 and 2 * len(on(b)) >= having(b[0])}

    def witness(p, b):
        own, other = sum(len(t) for n, t in p if (n, t) not in shared), sum(len(t) for n, t in p) - len(b[1])
        return 2 * own > other

    template = {b for b in shared if (n := sum(witness(p, b) for p in on(b))) >= 3 and 2 * n >= having(b[0])}
    return ["\n\n".join(t for n, t in ([b for b in p if b not in template] or p)) for p in pages]


def test_extraction_of_generated_hosts(spark):
    rng, rows, want = random.Random(12), [], []
    for h in range(40):
        pages = host_pages(rng, f"h{h}")
        want += slow(pages)
        rows += [(len(rows) + k, f"http://h{h}/{k}", "<html><body>" + "".join(f"<div class='{n}'>{t}</div>" for n, t in p) + "</body></html>") for k, p in enumerate(pages)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.text for r in sorted(got)] == want
    plain = ["\n\n".join(t for _, t in html.blocks(r[2])) for r in rows]
    assert sum(a != b for a, b in zip(plain, want)) > 50


def loss(d, w, ridge=1e-4):
    s = d.std(axis=0) + 1e-9
    return np.log1p(np.exp(-d @ w)).mean() + ridge / 2 * ((w * s) ** 2).sum()


def test_pairwise_fit_is_near_the_optimum_over_all_pairs():
    rng = np.random.default_rng(2)
    y = (rng.random(120) < 0.5).astype(int)
    x = rng.normal(size=(120, 4)) + y[:, None] * np.array([1.5, -0.7, 0, 0.2])
    w, cut = quality.fit(x, y)
    d = np.array([a - b for a in x[y == 1] for b in x[y == 0]])
    best = np.zeros(4)
    for _ in range(50):  # Newton over all pairs
        p = 1 / (1 + np.exp(d @ best))
        r = 1e-4 * (d.std(axis=0) + 1e-9) ** 2
        best += np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + np.diag(r), d.T @ p / len(d) - r * best)
    assert loss(d, w) < loss(d, best) * 1.02
    # Of cuts with the fewest errors it is the middle, which may make a few more.
    s = x @ w
    errors = lambda c: ((s >= c).astype(int) != y).sum()
    assert errors(cut) <= min(errors(c) for c in [*s, s.max() + 1]) + 0.02 * len(y)


def test_scores_are_those_of_the_model_and_labels_of_one_id_count_once(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["word", "other", "%%%", "12"] if k % 3 else ["plain", "prose", "here."], k=30)) for k in range(60)]
    docs = spark.createDataFrame([(k, t, 7.0) for k, t in enumerate(texts)] + [(None, None, 7.0), (3, texts[3], 7.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)] + [(6, 0), (6, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs.drop("score"), model).collect()}
    for k, t in enumerate(texts):
        assert abs(got[k] - 1 / (1 + np.exp(-np.clip(quality.features(t) @ model[0] - model[1], -30, 30)))) < 1e-12
    again = quality.train(docs, labels.where("not (doc_id = 6 and quality = 0)"))
    assert (again[0] == model[0]).all() and again[1] == model[1]
    for kind, side in ((1, 1), (0, 0)):
        one = quality.classify(docs, labels.withColumn("quality", F.lit(kind))).collect()
        assert len(one) == 62 and {r.predicted for r in one} == {side}
