"""Language ID: script ranges narrow candidates, Viterbi over per-word scores labels spans."""
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS, ORDERS, SWITCH, LEAST_SCRIPT = 1 << 15, (1, 2, 3), 8.0, 0.01
#: First code points of script ranges, as Unicode lays them out; a range runs to the next one.
SCRIPTS = np.array([0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0xE00, 0x10A0, 0x1100, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xFF00, 0x10000])
#: The Latin ranges 0 and 0x1E00 are one script.
SAME = {11: 0}
#: Letters are 1; marks, which go on with a word but start none, are 2.
_kind = lambda c: {"L": 1, "M": 2}.get(unicodedata.category(chr(c))[0], 0)
_LETTER = np.array([_kind(c) for c in range(0x10000)] + [0], np.int8)


def _lowered(text: str) -> str:
    """Lower case, place by place: a capital that would become two code points stays."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _units(text: str | None):
    """Word bounds in a text's code points, scripts of the words, and hashed n-grams of the lower-cased text with their words.

    A word is a letter and the letters and marks after it.
    """
    code = np.frombuffer(_lowered(text or "").encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    kind = _LETTER[np.minimum(code, 0x10000)]
    if len(high := np.flatnonzero(code > 0xFFFF)):
        kind[high] = [_kind(c) for c in code[high]]
    letter = np.concatenate(([False], kind > 0, [False]))
    edge = np.diff(letter.astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if (kind[starts] == 2).any():
        # Marks before the first letter are no part of a word.
        first = np.append(np.flatnonzero(kind == 1), len(code))
        first = first[np.searchsorted(first, starts)]
        for a, z in zip(starts[first > starts], np.minimum(first, ends)[first > starts]):
            letter[a + 1 : z + 1] = False
        starts, ends = first[first < ends], ends[first < ends]
    if not len(starts):
        return starts, ends, starts, []
    script = np.searchsorted(SCRIPTS, code[starts], "right") - 1
    for a, b in SAME.items():
        script[script == a] = b
    # Words apart by one zero on each side, so that n-grams see where a word starts and ends.
    inside = letter[1:-1]
    c = np.concatenate(([0, 0], np.where(inside, code, 0), [0]))
    grams = []
    for n in ORDERS:
        h = np.full(len(code), n, np.int64)
        for j in range(n):
            h = (h * 1_000_003 + c[2 - (n - 1 - j) : 2 - (n - 1 - j) + len(code)]) & 0x7FFFFFFF
        grams.append(((h * 2_654_435_761) >> 12) & (BUCKETS - 1))
    return starts, ends, script, grams


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang"):
    """Languages, log-likelihoods of hashed n-grams and the languages allowed in each script.

    Counts cover all rows given, summed by Spark; the model has BUCKETS values for each language and order.
    """
    width, ns = len(ORDERS) * BUCKETS, len(SCRIPTS)

    def count(batches):
        got: dict[str, np.ndarray] = {}
        for b in batches:
            for t, lang in zip(b["t"], b["lang"]):
                s, e, script, grams = _units(t)
                if len(s):
                    x = got.setdefault(lang, np.zeros(width + ns, np.int64))
                    inside = np.zeros(len(grams[0]) + 1, np.int64)
                    inside[s], inside[e] = 1, -1
                    ok = np.cumsum(inside)[:-1] > 0
                    for k, g in enumerate(grams):
                        x[k * BUCKETS : (k + 1) * BUCKETS] += np.bincount(g[ok], minlength=BUCKETS)
                    x[width:] += np.bincount(script, e - s, ns).astype(np.int64)
        for lang, x in got.items():
            at = np.flatnonzero(x)
            yield pd.DataFrame({"lang": lang, "k": at, "n": x[at]})

    rows = docs.select(F.col(text_col).alias("t"), F.col(lang_col).alias("lang")).where("t is not null and lang is not null")
    rows = rows.mapInPandas(count, "lang string, k int, n long").groupBy("lang", "k").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "n"))).alias("x")).collect()
    langs = sorted(r.lang for r in rows)
    n = np.zeros((width + ns, len(langs)))
    for r in rows:
        n[[x.k for x in r.x], langs.index(r.lang)] = [x.n for x in r.x]
    allowed = n[width:] >= LEAST_SCRIPT * np.maximum(1, n[width:].sum(axis=0))
    g = n[:width].reshape(len(ORDERS), BUCKETS, len(langs)) + 0.1
    weight = np.array([0.2, 0.6, 1.0])[:, None, None]
    return langs, (np.log(g / g.sum(axis=1, keepdims=True)) * weight).astype(np.float32), allowed


def spans(text: str | None, model) -> list[tuple[int, int, int]]:
    """(start, end, language index) of the text's spans in code points: Viterbi over its words, a switch costs SWITCH."""
    langs, table, allowed = model
    starts, ends, script, grams = _units(text)
    if not len(starts) or not langs:
        return []
    score = np.zeros((len(grams[0]) + 1, len(langs)))
    for k, g in enumerate(grams):
        score[1:] += table[k][g]
    total = np.cumsum(score, axis=0)
    e = total[ends] - total[starts]
    ok = allowed[script] | ~allowed[script].any(axis=1, keepdims=True)
    e = np.where(ok, e, e - 50.0)
    # A path that is in the best language somewhere has a switch for each stretch elsewhere: it is no better if no
    # stretch gains more than a switch. One that is never in it has one switch less: all its words must gain no more.
    best = int(e.sum(axis=0).argmax())
    gain = np.concatenate((np.zeros((1, len(langs))), np.cumsum(e - e[:, [best]], axis=0)))
    never = np.delete(e - e[:, [best]], best, axis=1).max(axis=1, initial=-np.inf).sum()
    if never <= SWITCH and (gain - np.minimum.accumulate(gain, axis=0)).max() <= SWITCH:
        return [(int(starts[0]), int(ends[-1]), best)]
    rows = e.tolist()  # few languages: lists are faster here than arrays
    back, v = [], rows[0]
    for r in rows[1:]:
        top = max(v)
        least, k = top - SWITCH, v.index(top)
        back.append([j if x >= least else k for j, x in enumerate(v)])
        v = [max(x, least) + y for x, y in zip(v, r)]
    path = [v.index(max(v))]
    for b in reversed(back):
        path.append(b[path[-1]])
    path = np.array(path[::-1])
    cut = np.concatenate(([0], np.flatnonzero(np.diff(path)) + 1, [len(path)]))
    return [(int(starts[a]), int(ends[b - 1]), int(path[a])) for a, b in zip(cut[:-1], cut[1:])]


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 4, part: int = 2) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score, spans.

    lang_pred is the language of most of the text's span length, score that share. It learns from rows
    that are not held out. `und`, score 0 and no spans where text is null, has no letter or nothing
    could be learned; ties go to the language first by name; repeated rows each give a row.
    """
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))
    model = train(docs.where(~held), text_col, lang_col)
    b = docs.sparkSession.sparkContext.broadcast(model)
    d = docs.select(F.col(id_col).alias("id"), held.alias("held_out"), F.col(text_col).alias("t"))

    def run(batches):
        for x in batches:
            out = []
            for t in x["t"]:
                s = spans(t, b.value)
                n = np.zeros(max(1, len(b.value[0])))
                for a, e, k in s:
                    n[k] += e - a
                k = int(n.argmax())
                out.append((b.value[0][k] if s else "und", n[k] / n.sum() if s else 0.0, [{"start": a, "end": e, "lang": b.value[0][k]} for a, e, k in s]))
            yield pd.DataFrame({"id": x["id"], "held_out": x["held_out"], "lang_pred": [o[0] for o in out], "score": [o[1] for o in out], "spans": [o[2] for o in out]})

    return d.mapInPandas(run, f"id {dict(d.dtypes)['id']}, held_out boolean, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>").withColumnRenamed("id", id_col)
