"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment."""
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

_WORD = re.compile(r"\w+")
N, LEAST, RARE, FEW, WITHIN, BLOCK_GRAMS, SLACK = 3, 0.7, 1e-3, 100, 4, 500_000, 1.5
STRETCH, FEWEST = 20, 10


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int]:
    """Best local alignment (match 2, mismatch -1, gap -1) over the most an item can score; its end."""
    row, best, end = np.zeros(len(passage) + 1), 0.0, 0
    at = np.arange(len(passage) + 1)
    for x in item:
        new = np.maximum(0, row - 1)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(passage == x, 2, -1))
        row = np.maximum.accumulate(new + at) - at
        if row.max() > best:
            best, end = float(row.max()), int(row.argmax())
    return best / (2 * max(1, len(item))), end


def covered(words: int) -> int:
    """Item words that a quoted stretch must cover: half the item, STRETCH at most and FEWEST at least."""
    return max(FEWEST, min(STRETCH, -(-words // 2)))


def stretch(item: np.ndarray, passage: np.ndarray, need: int, least: float) -> float:
    """Score of a local alignment over the most its own stretch of the item can score, for stretches of `need` words or more; 0 below `least`.

    Each item word also costs what it must score at `least`, so that an alignment's value tells whether
    it does. Cells hold value and start in one number; of equal values the longer stretch wins. From
    both ends, as a stretch grows only ahead.
    """
    top, best, base = 1000, 0.0, 1 << 20
    each = round(2 * least * top)
    at = np.arange(len(passage) + 1) * top * base
    for x, y in ((item, passage), (item[::-1], passage[::-1])):
        row = np.full(len(y) + 1, base - 1)
        for i, w in enumerate(x):
            new = np.maximum(base - 2 - i, row - (top + each) * base)
            new[1:] = np.maximum(new[1:], row[:-1] + np.where(y == w, 2 * top - each, -top - each) * base)
            row = np.maximum.accumulate(new + at) - at
            value, n = row >> 20, i + 1 - (base - 1 - (row & (base - 1)))
            if i + 1 >= need and (ok := n >= need).any():
                best = max(best, float(((value[ok] / top + 2 * least * n[ok]) / (2 * n[ok])).max()))
    return best if best >= least - 1e-9 else 0.0


def _scanner(docs: DataFrame, grams: dict, schema: str, emit):
    """Rows emit(id, text words, positions, grams' values) of the documents that hold some of the grams."""
    vocab: dict[str, int] = {}
    for g in grams:
        for w in g:
            vocab.setdefault(w, len(vocab))
    v = len(vocab) + 1
    codes = {}
    for g, x in grams.items():
        k = 0
        for w in g:
            k = k * v + vocab[w] & 0xFFFFFFFFFFFFFFFF
        # In 64 bits, as below: a gram of many words may share its code, and alignment tells.
        codes.setdefault(len(g), {})[k - (1 << 64) if k >> 63 else k] = x
    b = docs.sparkSession.sparkContext.broadcast((vocab, v, codes))

    def run(batches):
        vocab, v, codes = b.value
        keys = {n: np.sort(np.fromiter(c, np.int64)) for n, c in codes.items()}
        get = vocab.get
        for batch in batches:
            out = []
            for i, t in zip(batch["id"], batch["t"]):
                ws = words(t)
                ids = np.fromiter((get(w, -1) for w in ws), np.int64, len(ws))
                for n, ks in keys.items():
                    if len(ids) < n:
                        continue
                    k, ok = np.zeros(len(ids) - n + 1, np.int64), np.ones(len(ids) - n + 1, bool)
                    for j in range(n):
                        part = ids[j : len(ids) - n + 1 + j]
                        k, ok = k * v + part, ok & (part >= 0)
                    pos = np.flatnonzero(ok)
                    pos = pos[ks[np.minimum(np.searchsorted(ks, k[pos]), len(ks) - 1)] == k[pos]]
                    if len(pos):
                        out += emit(i, ws, pos.tolist(), [codes[n][x] for x in k[pos].tolist()])
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return docs.mapInPandas(run, schema)


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = N, least: float = LEAST) -> DataFrame:
    """(id, item_id, score, start_word) of every document that holds an item, an edited copy of it or a stretch of it.

    start_word is the first word of the best alignment, words from 0; rows that share an id are one document.

    An item's seeds are its n-grams in at most RARE of all documents (FEW at least), or in at most twice as
    many as its rarest one, and of any WITHIN neighbours the rarest; document frequencies are counted over all documents. Passages around seeds are aligned
    with the item; a score of `least` is a copy of which about a fifth of the words were replaced. A
    stretch of covered() item words that scores `least` of its own best counts too, with that score.
    Items are taken in blocks of BLOCK_GRAMS n-grams, so what is broadcast has a bound at any number
    of items. Null and empty texts and items match nothing; items shorter than n words are one
    seed; repeated rows are reported once; an empty table gives no rows.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t is not null")
    kind = dict(d.dtypes)["id"]
    it = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("t")).where("t is not null and item is not null").distinct()
    # A block of items has BLOCK_GRAMS words at most, or one item; words as words() finds them.
    sizes = it.withColumn("n", F.regexp_count("t", F.lit(r"(?U)\w+")).cast("long"))
    blocks = max(1, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // (BLOCK_GRAMS // 2)))
    total, parts = d.count(), []
    for k in range(blocks):
        rows = it.where(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == k).collect()
        item_words = [(r.item, words(r.t)) for r in rows]
        own, grams = [], {}
        for q, (_, ws) in enumerate(item_words):
            m = min(n, len(ws))
            for p in range(len(ws) - m + 1 if ws else 0):
                own.append((q, p, grams.setdefault(tuple(ws[p : p + m]), len(grams))))
        if not own:
            continue
        count = _scanner(d, grams, "g long", lambda i, ws, pos, g: [(x,) for x in set(g)]).groupBy("g").agg(F.count("*").alias("df"))
        table = written(d.sparkSession.createDataFrame(own, "q long, p int, g long").join(count, "g"))
        # Copies raise the counts of what they hold: an item's own level is that of its rarest n-gram.
        table = table.withColumn("bar", F.greatest(F.lit(max(FEW, RARE * total)), 2 * F.min("df").over(W.partitionBy("q"))))
        near = W.partitionBy("q").orderBy("p").rowsBetween(0, WITHIN - 1)
        table = table.withColumn("pick", F.min(F.struct("df", "p")).over(near)["p"])
        seeds = table.where("df <= bar").select("g", "q", "p").union(table.join(table.select("q", F.col("pick").alias("p")).distinct(), ["q", "p"], "left_semi").select("g", "q", "p")).distinct()
        post: dict[int, list] = {}
        for r in seeds.select("g", "q", "p").collect():
            post.setdefault(r.g, []).append((r.q, r.p))
        wanted = {g: post[x] for g, x in grams.items() if x in post}
        length = [len(ws) for _, ws in item_words]

        def windows(i, ws, pos, hits, length=length):
            """Per item, passages that hold its seeds: seeds closer than the item's length share one."""
            at: dict[int, list] = {}
            for p, g in zip(pos, hits):
                for q, o in g:
                    at.setdefault(q, []).append(max(0, p - o))
            out = []
            for q, starts in at.items():
                starts, reach = sorted(starts), int(SLACK * length[q]) + 4
                lo = hi = starts[0]
                for s in [*starts[1:], None]:
                    if s is not None and s - hi <= reach // 2:
                        hi = s
                        continue
                    a = max(0, lo - reach // 2)
                    out.append((i, q, a, " ".join(ws[a : hi + reach])))
                    lo = hi = s
            return out

        found = _scanner(d, wanted, f"id {kind}, q int, at int, passage string", windows).repartition(F.xxhash64("id", "q", "at"))
        b = d.sparkSession.sparkContext.broadcast(item_words)

        def scored(batches, b=b):
            @lru_cache(20_000)
            def one(q, passage):
                ids: dict[str, int] = {}
                code = lambda ws: np.array([ids.setdefault(w, len(ids)) for w in ws])
                item, other = code(b.value[q][1]), code(passage.split(" "))
                score, end = align(item, other)
                # No stretch scores more than the whole alignment.
                need = covered(len(item))
                if score < least and need <= len(item) and score * len(item) >= least * need:
                    score = max(score, stretch(item, other, need, least))
                if score < least:
                    return score, 0
                return score, end - align(item[::-1], other[:end][::-1])[1]

            for x in batches:
                got = [one(q, p) for q, p in zip(x["q"], x["passage"])]
                yield pd.DataFrame({"id": x["id"], "item_id": [b.value[q][0] for q in x["q"]], "score": [g[0] for g in got], "start_word": [a + g[1] for a, g in zip(x["at"], got)]})

        parts.append(found.mapInPandas(scored, f"id {kind}, item_id {dict(it.dtypes)['item']}, score double, start_word int").where(F.col("score") >= least))
    if not parts:
        return d.select(F.col("id").alias(id_col), F.lit(None).cast(dict(it.dtypes)["item"]).alias("item_id"), F.lit(0.0).alias("score"), F.lit(0).alias("start_word")).where("false")
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    best = F.max(F.struct("score", (-F.col("start_word")).alias("s"))).alias("m")
    return written(out.groupBy("id", "item_id").agg(best).select(F.col("id").alias(id_col), "item_id", F.round("m.score", 6).alias("score"), (-F.col("m.s")).alias("start_word")))
