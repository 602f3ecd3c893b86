"""Substring dedup: MinHash of overlapping paragraphs, exact extension of what collides, clusters by components."""
import re

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import components, discard, frame, hot_join, written

SHINGLE, LEAST, RECALL, RUN_WORDS, KEY_WORDS, CACHE, EDIT = 5, 0.8, 0.995, 50, 8, 500_000, 8
_WORD = re.compile(r"[^\W_]+")
_FULL = (1 << 64) - 1
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tune(least: float = LEAST, recall: float = RECALL, stray: float = 0.05, low: float = 0.01) -> tuple[int, int]:
    """(bands, rows): the fewest bands that find pairs of similarity `least` with `recall`, and collide at `low` in under `stray`."""
    for rows in range(1, 16):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - least**rows)))
        if 1 - (1 - low**rows) ** bands < stray:
            break
    return bands, rows


def sizes(run_words: int = RUN_WORDS, least: float = LEAST) -> tuple[int, int]:
    """(words of a key, paragraph starts): a passage of run_words offers as many disjoint paragraphs, one MinHash each, as tune() asks bands for a recall of 0.99."""
    key = min(KEY_WORDS, run_words)
    return key, max(1, (run_words - key + 1) // tune(least, 0.99)[0])


#: Source document and diagonal at either end of a stretch.
FACE = ("fa", "da", "fb", "db")
KEYS = ("at", "key", "keep", "fdk", "fat", "again")


class _Hashes(dict):
    def __missing__(self, w: str) -> int:
        h = xxhash.xxh64_intdigest(w)
        if len(self) < CACHE:
            self[w] = h
        return h


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of word hashes."""
    x = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for j in range(n):
        x = (x ^ h[j : j + len(x)]) * _A
        x ^= x >> np.uint64(29)
    return x * _B


def anchors(h: np.ndarray, key_words: int, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys) of a text's paragraphs by their word hashes.

    A paragraph is each stretch of `starts` key starts; its MinHash is its smallest five-word shingle,
    the first of equals, and its key the key_words words from there. Neighbours that share a MinHash
    give it once, and a word that goes on repeating gives one. Stretches of starts + key_words - 1
    words that are equal in two texts have a key in common, whatever stands around them.
    """
    keys = _grams(h, key_words)
    if len(keys) < starts:
        return np.zeros(0, np.int64), keys[:0]
    low = _grams(h, min(SHINGLE, key_words))[: len(keys)]
    at = np.unique(np.lib.stride_tricks.sliding_window_view(low, starts).argmin(axis=1) + np.arange(len(keys) - starts + 1))
    at = at[(at == 0) | (keys[at] != keys[np.maximum(at, 1) - 1])]
    return at, keys[at]


def windows(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each place on; 0 where the text ends before. Polynomial prefix sums, so n costs nothing."""
    powers = lambda x: np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(len(h), x, np.uint64), dtype=np.uint64)))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * powers(_A)[:-1], dtype=np.uint64)))
    good = at + n <= len(h)
    a = np.where(good, at, 0)
    x = (total[np.minimum(a + n, len(h))] - total[a]) * powers(np.uint64(pow(int(_A), -1, 1 << 64)))[a]
    return np.where(good, (x ^ x >> np.uint64(29)) * _B | np.uint64(1), np.uint64(0))


def stretches(at: np.ndarray, source: np.ndarray, diagonal: np.ndarray, again: np.ndarray, key_words: int, starts: int, run_words: int) -> list[tuple[int, int]]:
    """(first, last) index of neighbouring places that stand together in one earlier document, of runs that can hold a passage.

    Neighbours are no further apart than a paragraph, and either their first document (source) has both
    at the same distance (diagonal), or both lie in a window of run_words - starts + 1 words, from a
    place where `again` holds, that some earlier document has as a whole; each passage of run_words in
    one document has such windows. In a run two stretches may stand apart by an edit: both ends of one
    lose starts - 1 words and the key's.
    """
    out, gap, long = [], np.diff(at), run_words - starts + 1
    seen = np.maximum.accumulate(np.where(again, at, -long))
    together = (gap <= starts) & ((source[1:] == source[:-1]) & (diagonal[1:] == diagonal[:-1]) | (seen[:-1] + long >= at[1:] + key_words))
    for run in np.split(np.arange(len(at)), np.flatnonzero(gap > 2 * starts + key_words) + 1):
        if len(run) and at[run[-1]] + key_words - at[run[0]] >= run_words - 2 * (starts - 1):
            out += [(int(x[0]), int(x[-1])) for x in np.split(run, np.flatnonzero(~together[run[:-1]]) + 1)]
    return out


def passages(parts: list[tuple], run_words: int, least: float) -> list[tuple[int, int]]:
    """(start, stop) of the passages of run_words that stretches (start, stop, source and diagonal at either end) of a document make.

    Touching stretches are one where the source goes on, up to an edit, or where both are passages; pieces
    of several documents are no passage. Stretches of one source apart by g words are one passage if they
    hold 40 + 8 g words (0.8 of five-word shingles, an edit of g words between them) and the Jaccard
    similarity of all shingles, those outside stretches counted as different ones on both sides, is `least`.
    """
    one: list[list] = []
    follows = lambda x, y: x[4] == y[2] and abs(x[5] - y[3]) <= EDIT
    for y in sorted(parts):
        x = one[-1] if one else None
        if x and y[0] <= x[1] and (follows(x, y) or min(x[1] - x[0], y[1] - y[0]) >= run_words or y[1] <= x[1]):
            one[-1] = [x[0], y[1], *x[2:4], *y[4:6]] if y[1] > x[1] else x
        else:
            one.append(list(y))
    out, group = [], []

    def close():
        if not group:
            return
        a, b = group[0][0], group[-1][1]
        lost = sum(max(0, y[0] - x[1]) + SHINGLE - 1 for x, y in zip(group, group[1:]))
        n = max(1, b - a - SHINGLE + 1)
        if b - a >= run_words and n - lost >= least * (n + lost):
            out.append((a, b))
        else:
            out.extend((x[0], x[1]) for x in group if x[1] - x[0] >= run_words)

    for x in one:
        if group:
            g = max(0, x[0] - group[-1][1])
            if not follows(group[-1], x) or group[-1][1] - group[-1][0] + x[1] - x[0] < 40 + 8 * g:
                close()
                group = []
        group.append(x)
    close()
    # Passages of different sources may overlap: what they cover goes once.
    whole: list[list[int]] = []
    for a, b in sorted(out):
        if whole and a <= whole[-1][1]:
            whole[-1][1] = max(whole[-1][1], b)
        else:
            whole.append([a, b])
    return [(a, b) for a, b in whole]


def _met(place: DataFrame, key: str = "key") -> DataFrame:
    """place, where its key is one that two documents have, with the first of them: fdk, its id (keep) and the key's first place there (fat).

    One shuffle by key; keys that a 64th of the places (by hash) shows to hold over a 500th of all (at
    most 1,000 of them) are aggregated first and joined by broadcast, so no task holds a hot key.
    """
    own = F.struct(F.isnull("id").alias("n"), "id", "dk", "at")
    some = place.where(F.pmod(F.xxhash64("dk", "at"), F.lit(64)) == 0).groupBy(key).agg(F.count("*").alias("n"))
    bar = max(200, (some.agg(F.sum("n")).first()[0] or 0) // 500)
    hot = [r[0] for r in some.where(F.col("n") > bar).select(key).collect()]
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    w = W.partitionBy(key)
    names = [*place.columns, F.col("f.dk").alias("fdk"), F.col("f.id").alias("keep"), F.col("f.at").alias("fat")]
    out = place.where(~is_hot).withColumns({"lo": F.min("dk").over(w), "hi": F.max("dk").over(w), "f": F.min(own).over(w)}).where("lo <> hi").select(*names)
    if hot:
        first = place.where(is_hot).groupBy(key).agg(F.min("dk").alias("lo"), F.max("dk").alias("hi"), F.min(own).alias("f")).where("lo <> hi")
        out = out.unionByName(place.where(is_hot).join(F.broadcast(first), key).select(*names))
    return out


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, run_words: int = RUN_WORDS) -> DataFrame:
    """(id, first_word, n_words, first_par, last_par, keep_id, cluster_id): passages that are to go, by document.

    Texts are lower-case words, lines of them numbered. Overlapping paragraphs are MinHashed; keys
    that two documents share are joined, and a key is to go wherever it isn't in its first document by
    id. Keys to go that follow each other are stretches where one earlier document has them so (see
    stretches), so pieces of many documents are none; their ends are extended, word by word and
    exactly, as far as what stands there is in an earlier document too. Stretches make passages of
    run_words, edits of one source bridged at a Jaccard similarity of `least`. Passages that share the keys at their
    ends are clusters. keep_id is the first document of the passage's first key.
    A passage may start and end anywhere in a line. Documents are told apart by a 64-bit hash of id and text, null ids
    sort last; a row that repeats id and text counts once. What repeats within one document only
    stays. Null, empty and wordless texts match nothing; an empty table gives no rows.
    """
    key_words, starts = sizes(run_words, least)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t is not null").withColumn("dk", F.xxhash64("id", "t"))
    # Ids pass through Python as text: a null would make pandas turn whole numbers into floats.
    kind = dict(d.dtypes)["id"]
    text = d.withColumn("id", F.col("id").cast("string"))
    back = lambda x, *names: x.withColumns({n: F.col(n).cast(kind) for n in names})

    def paragraphs(batches):
        known = _Hashes()
        for b in batches:
            ids, dks, at, keys, long = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for i, dk, t in zip(b["id"], b["dk"], b["t"]):
                ws = _WORD.findall(t.lower())
                if len(ws) >= run_words:
                    h = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
                    a, k = anchors(h, key_words, starts)
                    long.append(windows(h, a, run_words - starts + 1))
                    ids += [i] * len(a)
                    dks.append(np.full(len(a), dk))
                    at.append(a)
                    keys.append(k)
            yield pd.DataFrame({"id": pd.Series(ids, dtype=object), "dk": np.concatenate([at[0], *dks]), "at": np.concatenate(at), "key": np.concatenate(keys).view(np.int64), "long": np.concatenate(long).view(np.int64)})

    place = written(back(text.mapInPandas(paragraphs, "id string, dk long, at int, key long, long long"), "id"), "zstd")
    hits = written(_met(place), "zstd")
    discard(place)
    # Which places' windows an earlier document has as a whole.
    again = _met(hits.where("long <> 0").select("id", "dk", "at", "long"), "long").where("dk <> fdk").select("id", "dk", "at")

    def runs(batches):
        for b in batches:
            out = []
            for i, dk, at, key, keep, source, fat, again in zip(*(b[c] for c in ("id", "dk", *KEYS))):
                m = ~again
                seen, at, key, keep, source = at[again], at[m], key[m], keep[m], source[m]
                diagonal = at - fat[m]
                for p, q in stretches(at, source, diagonal, np.isin(at, seen), key_words, starts, run_words):
                    out.append((i, dk, at[p], at[q], key[p], key[q], keep[p], source[p], diagonal[p], source[q], diagonal[q]))
            yield frame(out, "id", "dk", "a", "b", "ka", "kb", "keep", "fa", "da", "fb", "db")

    # A window's row has zeros. Lists of plain values reach pandas as arrays: lists of structs, as dicts, take ten times the memory.
    none = F.lit(0).cast("long")
    per = hits.where("dk <> fdk").select("id", "dk", "at", "key", "keep", "fdk", "fat", F.lit(False).alias("again"))
    per = per.union(again.select("id", "dk", "at", none, F.lit(None), none, none, F.lit(True)))
    per = per.groupBy(F.col("id").cast("string").alias("id"), "dk").agg(F.array_sort(F.collect_set(F.struct("at", "key", F.col("keep").cast("string").alias("keep"), "fdk", "fat", "again"))).alias("x"))
    per = per.select("id", "dk", *[F.col(f"x.{c}").alias(c) for c in KEYS])
    part = written(back(per.mapInPandas(runs, "id string, dk long, a int, b int, ka long, kb long, keep string, fa long, da int, fb long, db int"), "id", "keep"))
    # What stands before and after the keys at stretches' ends, wherever those keys stand.
    ends = part.select(F.col("ka").alias("key"), F.lit(True).alias("left")).union(part.select("kb", F.lit(False))).distinct()
    asked = hits.join(ends, "key").groupBy("dk").agg(F.collect_set(F.struct("at", "key", "left")).alias("x"))

    def packed(batches):
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield pd.DataFrame({"dk": b["dk"], "z": pd.Series([z.compress(t.encode("utf-8", "surrogatepass")) for t in b["t"]], dtype=object)})

    def around(batches):
        known, z = _Hashes(), zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for dk, t, x in zip(b["dk"], b["z"], b["x"]):
                found = [_WORD.findall(y) for y in z.decompress(t).decode("utf-8", "surrogatepass").lower().split("\n")]
                ws, line = [w for y in found for w in y], np.repeat(np.arange(len(found)), [len(y) for y in found])
                for r in x:
                    at, left, ext = r["at"], r["left"], r["key"] & _FULL
                    end = at if left else at + key_words - 1
                    ps = range(end, max(-1, end - starts), -1) if left else range(end, min(len(ws), end + starts))
                    exts = []
                    for j, p in enumerate(ps):
                        if j:
                            ext = ((ext ^ ext >> 29) * 0x9E3779B97F4A7C15 + known[ws[p]]) & _FULL
                        exts.append(ext - (1 << 64) if ext >> 63 else ext)
                    out.append((dk, at, left, exts, line[ps.start : ps.stop if ps.stop >= 0 else None : ps.step].tolist()))
            yield frame(out, "dk", "at", "left", "exts", "lines")

    texts = d.select("dk", "t").mapInPandas(packed, "dk long, z binary")
    occ = texts.join(asked, "dk").mapInPandas(around, "dk long, at int, left boolean, exts array<long>, lines array<int>")
    occ = written(occ.distinct().withColumn("all", F.element_at("exts", -1)), "zstd")
    # Of equal surroundings the first document's stand for all; elsewhere they are shared to their end.
    order = hits.select("dk", F.struct(F.isnull("id").alias("n"), "id", "dk").alias("own")).distinct()
    same = written(occ.join(order, "dk").groupBy("left", "all").agg(F.min("own").alias("f"), F.first("exts").alias("exts"), F.count("*").alias("n")))
    each = same.select("left", "all", "f", F.posexplode("exts").alias("j", "ext"))
    known = each.groupBy("left", "j", "ext").agg(F.min("f").alias("first"), F.count("*").alias("k")).where("k > 1").select("left", "j", "ext", F.col("first.dk").alias("fdk"))
    reach = each.join(known, ["left", "j", "ext"]).where("f.dk <> fdk").groupBy("left", "all").agg(F.max("j").alias("j"))
    reach = written(same.join(reach, ["left", "all"], "left").select("left", "all", F.col("f.dk").alias("fdk"), "j", "n"))
    far = hot_join(occ, reach, "left", "all").withColumn("j", F.when(F.col("dk") != F.col("fdk"), F.size("exts") - 1).otherwise(F.col("j"))).where("j is not null")
    far = written(far.select(F.col("dk").alias("dk2"), "at", "left", "j", F.get("lines", F.col("j")).alias("line")))
    discard(occ, same, reach)
    e = part.join(far.where("left"), (F.col("dk") == F.col("dk2")) & (F.col("a") == F.col("at"))).select("id", "dk", "b", "ka", "kb", "keep", *FACE, (F.col("a") - F.col("j")).alias("start"), F.col("line").alias("l0"))
    e = e.join(far.where("not left"), (F.col("dk") == F.col("dk2")) & (F.col("b") == F.col("at"))).select("id", "dk", "ka", "kb", "keep", *FACE, "start", "l0", (F.col("b") + key_words + F.col("j")).alias("stop"), F.col("line").alias("l1"))

    def whole(batches):
        for b in batches:
            out = []
            for i, dk, x in zip(b["id"], b["dk"], b["x"]):
                x = sorted(x, key=lambda r: (r["start"], r["stop"], r["ka"]))
                for s, t in passages([(r["start"], r["stop"], *(r[c] for c in FACE)) for r in x], run_words, least):
                    inside = [r for r in x if s <= r["start"] and r["stop"] <= t]
                    out.append((i, dk, s, t - s, inside[0]["l0"], max(r["l1"] for r in inside), inside[0]["keep"], [k for r in inside for k in (r["ka"], r["kb"])]))
            yield frame(out, "id", "dk", "first_word", "n_words", "first_par", "last_par", "keep_id", "keys")

    got = e.groupBy(F.col("id").cast("string").alias("id"), "dk").agg(F.collect_set(F.struct("start", "stop", "l0", "l1", "ka", "kb", *FACE, F.col("keep").cast("string").alias("keep"))).alias("x"))
    got = back(got.mapInPandas(whole, "id string, dk long, first_word int, n_words int, first_par int, last_par int, keep_id string, keys array<long>"), "id", "keep_id")
    got = written(got.withColumn("node", F.xxhash64("id", "dk", "first_word")))
    label = components(got.select(F.col("node").alias("a"), F.explode("keys").alias("b"))).toDF("node", "cluster_id")
    return got.join(label, "node").select(F.col("id").alias(id_col), "first_word", "n_words", "first_par", "last_par", "keep_id", "cluster_id")
