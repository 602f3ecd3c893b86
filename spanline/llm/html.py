"""HTML extraction by union-free wrappers, inferred by aligning the pages of one host: constant texts are template."""
import html as entities
import json
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frame, written

#: Parts of a page that are never main text, tags without a body, tags inside a line.
OUT = set("nav header footer aside form script style noscript template iframe svg button select textarea menu dialog head title object canvas video audio".split())
RAW = set("script style textarea title noscript template iframe".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
INLINE = set("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var wbr big strike".split())
CLOSED_BY_NEXT = {"p": "p", "li": "li", "dt": "dd", "dd": "dt", "tr": "tr", "td": "th", "th": "td", "option": "option"}
NOISE = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|newsletter|subscribe|sidebar|side|menu|nav\w*|breadcrumbs?|share|social|related|recommend\w*|comments?|disqus|replies|reply|header|footer|popup|modal|login|signup|search|widget|pagination|pager|toolbar|skip)(?:[\s_-]|$)", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|$)", re.S)
_ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SHARE, FAN, PAGES, SLOT_SHARE, LAYOUT_SHARE, TABLE = 256, 16, 3, 128, 1024, 1 << 24


def tokens(page: str | None) -> list[tuple[str, str]]:
    """(kind, value): tags as 'p', '/p' or 'div.ad sidebar', and text as '#'. Comments are passed over; raw bodies are one text."""
    page, out, at = page or "", [], 0
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            out.append(("#", page[at : m.start()]))
        at = m.end()
        if m[2]:
            name = m[2].lower()
            names = " ".join(x[1] or x[2] or x[3] for x in _ATTR.findall(m[3])) if not m[1] else ""
            out.append((f"{m[1]}{name}" + (f".{names}" if names else ""), ""))
            if not m[1] and name in RAW:
                end = re.compile(rf"</{name}\b", re.I).search(page, at)
                stop = end.start() if end else len(page)
                out.append(("#", page[at:stop]))
                at = stop
    if at < len(page):
        out.append(("#", page[at:]))
    return out


@dataclass(frozen=True)
class Place:
    """Where a text stands: the path of open block elements, as one name of fixed length, and what tags and names along it say.

    out: in a part that is never main text; noise, inner: the outermost element named as noise and the
    next one within it, or ''; held: in article or main.
    """

    path: str = ""
    out: bool = False
    noise: str = ""
    inner: str = ""
    held: bool = False

    def within(self, kind: str) -> "Place":
        tag, _, names = kind.partition(".")
        path = xxhash.xxh64_hexdigest(f"{self.path}>{kind}")
        noisy = tag not in ("html", "body") and NOISE.search(names)
        return Place(path, self.out or tag in OUT, self.noise or (path if noisy else ""), self.inner or (path if noisy and self.noise else ""), self.held or tag in ("article", "main") or "main" in names.split())

    def named(self) -> str:
        return f"{self.path}|{int(self.out)}|{self.noise}|{self.inner}|{int(self.held)}"


def blocks(page: str | None) -> list[tuple[str, str]]:
    """(place, text) of each block in page order; text in one space, trimmed, decoded.

    Inline elements leave the path as it is, and an element costs the same at any depth, so a page is
    read in time linear in its length.
    """
    stack: list[tuple[str, Place]] = [("", Place())]
    open_: Counter = Counter()
    out: list[list] = []

    def close(k: int):
        for tag, _ in stack[k:]:
            open_[tag] -= 1
        del stack[k:]

    for kind, value in tokens(page):
        if kind == "#":
            at = stack[-1][1]
            if out and out[-1] is not None and out[-1][0] is at:
                out[-1][1].append(value)
            else:
                out.append([at, [value]])
            continue
        tag = kind.partition(".")[0].lstrip("/")
        if tag == "br" and out and out[-1] is not None:
            out[-1][1].append(" ")
        if tag == "br" or tag in INLINE:
            continue
        if out and out[-1] is not None:
            out.append(None)
        if kind[0] == "/":
            if open_[tag]:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
        elif tag not in VOID:
            ends = {tag, CLOSED_BY_NEXT.get(tag)} if tag in CLOSED_BY_NEXT else {"p"}
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ends:
                    close(k)
                    break
                if stack[k][0] not in CLOSED_BY_NEXT:
                    break
            open_[tag] += 1
            stack.append((tag, stack[-1][1].within(kind)))
    got = [(b[0].named(), re.sub(r"\s+", " ", entities.unescape("".join(b[1]))).strip()) for b in out if b]
    return [(p, t) for p, t in got if t]


def folded(paths: list[str]) -> list:
    """A page as a wrapper: its text slots by path, equal neighbours folded into a repeated group."""
    out: list = []
    for p in paths:
        if out and out[-1][0] == p:
            out[-1][1] = "+"
        else:
            out.append([p, ""])
    return out


def suffixes(a: list[str], b: list[str]):
    """best(i, j): length of the longest common subsequence of a[i:] and b[j:].

    One long number for each place of a holds b's bits (a bit is off where the length grows), so that
    a row costs a few operations on it; lengths are counts of bits.
    """
    n, m = len(a), len(b)
    at: dict[str, int] = {}
    for p, x in enumerate(reversed(b)):
        at[x] = at.get(x, 0) | 1 << p
    full = (1 << m) - 1
    rows = [full] * (n + 1)
    for i in range(n - 1, -1, -1):
        v, hit = rows[i + 1], at.get(a[i], 0)
        u = v & hit
        rows[i] = (v + u | v - u) & full
    return lambda i, j: m - j - (rows[i] & (1 << m - j) - 1).bit_count()


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of a with each beginning of b."""
    at: dict[str, int] = {}
    for p, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << p
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & at.get(x, 0)
        v = (v + u | v - u) & full
    bits = np.unpackbits(np.frombuffer((full & ~v).to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(bits, dtype=np.int64)))


def matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, in order.

    What both begin or end with is matched at once; long rests are halved where their lengths add up
    (Hirschberg), so that memory is linear.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        if i == n or j == m:
            continue
        if (n - i) * (m - j) > TABLE and n - i > 1:
            k = (i + n) // 2
            cut = j + int(np.argmax(_lengths(a[i:k], b[j:m]) + _lengths(a[k:n][::-1], b[j:m][::-1])[::-1]))
            todo += [(i, k, j, cut), (k, n, cut, m)]
            continue
        best, x, y = suffixes(a[i:n], b[j:m]), 0, 0
        while x < n - i and y < m - j:
            if a[i + x] == b[j + y]:
                out.append((i + x, j + y))
                x, y = x + 1, y + 1
            elif best(x + 1, y) >= best(x, y + 1):
                x += 1
            else:
                y += 1
    return sorted(out)


def align(a: list, b: list) -> list:
    """One wrapper for two lists of slots (path, mark, pages): equal slots are matched in order, their pages added; slots that only one has become optional, mismatched repeats repeated."""
    out, i, j = [], 0, 0
    more = lambda x: [x[0], x[1] if "?" in x[1] else f"{x[1]}?", x[2]]
    for x, y in [*matches([s[0] for s in a], [s[0] for s in b]), (len(a), len(b))]:
        out += [more(s) for s in a[i:x]] + [more(s) for s in b[j:y]]
        if x < len(a):
            marks = a[x][1] + b[y][1]
            out.append([a[x][0], "+" * ("+" in marks) + "?" * ("?" in marks), a[x][2] + b[y][2]])
        i, j = x + 1, y + 1
    # Neighbouring slots of one path are one repeated group.
    merged: list = []
    for x in out:
        if merged and merged[-1][0] == x[0]:
            merged[-1] = [x[0], "+" + "?" * ("?" in merged[-1][1] and "?" in x[1]), max(merged[-1][2], x[2])]
        else:
            merged.append(x)
    return merged


def _best(paths: set, index: dict) -> int | None:
    """The wrapper that shares most paths, if it has half of them; the first one of equals."""
    votes: dict[int, int] = {}
    for p in paths:
        for k in index.get(p, ()):
            votes[k] = votes.get(k, 0) + 1
    k = min(votes, key=lambda k: (-votes[k], k), default=None)
    return k if k is not None and 2 * votes[k] >= len(paths) else None


def clustered(shapes) -> list[dict]:
    """Wrappers {pages, slots} of a host's layouts, of shapes or wrappers: one joins the wrapper that shares half of its paths, else it starts one.

    Slots on under 1/SLOT_SHARE of a layout's pages, and layouts of under 1/LAYOUT_SHARE of all pages
    given, go, so neither grows with a host: what so few pages have is a slot by its path (see fitted).
    """
    out, index = [], {}
    for s in shapes:
        k = _best({x[0] for x in s["slots"]}, index)
        if k is None:
            k = len(out)
            out.append(s)
        else:
            out[k] = {"pages": out[k]["pages"] + s["pages"], "slots": align(out[k]["slots"], s["slots"])}
        for x in s["slots"]:
            index.setdefault(x[0], set()).add(k)
    all_ = sum(w["pages"] for w in out)
    kept = [w for w in out if w["pages"] * LAYOUT_SHARE >= all_]
    return [w | {"slots": [x for x in w["slots"] if x[2] * SLOT_SHARE >= w["pages"]]} for w in kept]


def placed(wrapper: list, shape: list) -> list[int]:
    """The wrapper's slot of each slot of a page, matched in order as in align; -1 for none."""
    out = [-1] * len(shape)
    for i, j in matches([x[0] for x in wrapper], [x[0] for x in shape]):
        out[j] = i
    return out


@lru_cache(100_000)
def named(place: str, over: str | None = None) -> tuple[bool, str, bool]:
    """By tags and names alone: in a part that is never main text; the outermost element named as noise that is not `over`, or ''; in article or main."""
    _, out, noise, inner, held = place.split("|")
    return out == "1", inner if noise and noise == over else noise, held == "1"


@lru_cache(4096)
def _templates(listed: str | None) -> dict[tuple[int, int], int]:
    rows = [x.split() for x in (listed or "").split(",") if x]
    return {(int(k), int(h)): int(n) for k, h, n in rows}


@lru_cache(4096)
def _shape(s: str) -> list:
    return json.loads(s)


def _clean(shape: str, slots, over: str | None = None):
    """By tags and names, whether a block may be main text, and whether it stands in article or main."""
    paths = _shape(shape)
    for k in slots:
        out, noise, held = named(paths[k][0], over)
        yield not out and not noise, held


def main_text(shape: str, slots, texts, hashes, template: str | None = None, over: str | None = None) -> str:
    """Blocks that are no template text of the host, by tags and names, in article or main if the page has such blocks.

    Template text in article or main goes from one page more than PAGES on. A page that is all
    template keeps what tags and names leave.
    """
    known, clean, kept = _templates(template), [], []
    for k, t, h, (good, held) in zip(slots, texts, hashes, _clean(shape, slots, over)):
        if good:
            clean.append((t, held))
            if known.get((int(k), int(h)), 0) < PAGES + held:
                kept.append((t, held))
    kept = kept or clean
    inner = any(held for _, held in kept)
    return "\n\n".join(t for t, held in kept if held or not inner)


def witnessed(shape: str, slots, hashes, lengths, template: str) -> list[dict]:
    """The shared texts of a page whose other text, by tags and names, is mostly not shared: of these the page is a witness."""
    known = _templates(template)
    clean = [(int(k), int(h), int(n), (int(k), int(h)) in known) for k, h, n, (good, _) in zip(slots, hashes, lengths, _clean(shape, slots)) if good]
    whole, own = sum(x[2] for x in clean), sum(x[2] for x in clean if not x[3])
    return [{"k": k, "h": h} for k, h, n, shared in dict.fromkeys(clean) if shared and 2 * own > whole - n]


def _shares(shapes: DataFrame) -> DataFrame:
    """(host, shares): one share of a host's distinct shapes for each SHARE of them."""
    return shapes.groupBy("host").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))


def _salt():
    return F.pmod(F.xxhash64("s"), F.col("shares")).cast("int").alias("salt")


def wrappers(shapes: DataFrame) -> DataFrame:
    """(host, wrapper) inferred from the distinct shapes (host, s) of a host, several where its layouts differ.

    Shapes are aligned in shares of a host, of about SHARE shapes each, then FAN shares' wrappers with
    one another until a host has one share, so that a host that holds a third of all pages is no
    single task and tasks do not grow with it.
    """

    def merged(batches):
        key, held = None, []
        for b in batches:
            out = []
            for k, s in zip(zip(b["host"], b["salt"]), b["s"]):
                if k != key:
                    if key:
                        out += [(*key, json.dumps(w)) for w in clustered(held)]
                    key, held = k, []
                held.append(json.loads(s))
            yield frame(out, "host", "salt", "s")
        if key:
            yield frame([(*key, json.dumps(w)) for w in clustered(held)], "host", "salt", "s")

    # A shape as a wrapper of its pages.
    one = F.concat(F.lit('{"pages": '), "pages", F.lit(', "slots": '), F.regexp_replace("s", r'"\]', F.concat(F.lit('", '), F.col("pages").cast("string"), F.lit("]"))), F.lit("}"))
    d = shapes.join(_shares(shapes), "host").select("host", _salt(), one.alias("s"))
    while True:
        new = written(d.repartition("host", "salt").sortWithinPartitions("host", "salt", "s").mapInPandas(merged, "host string, salt int, s string"))
        if new.where("salt > 0").isEmpty():
            return new.select("host", F.get_json_object("s", "$.slots").alias("wrapper")).distinct()
        d = new.withColumn("salt", F.floor(F.col("salt") / FAN).cast("int"))


def fitted(shapes: DataFrame, w: DataFrame) -> DataFrame:
    """(host, sh, w, slots, ks, paths): each shape's wrapper by its hash, the wrapper's slot of each of its own, and which of its own no wrapper has, with their paths."""

    def fit(host, sh, shape, x, slots):
        ks = [i for i, q in enumerate(slots) if q < 0]
        return host, sh, x, slots, ks, [shape[i][0] for i in ks]

    def run(batches):
        key, ws, index = None, [], {}
        for b in batches:
            out = []
            for k, first, sh, s, x in zip(zip(b["host"], b["salt"]), b["first"], b["sh"], b["s"], b["w"]):
                if k != key:
                    key, ws, index = k, [], {}
                shape = json.loads(s)
                if first:
                    for y in shape:
                        index.setdefault(y[0], set()).add(len(ws))
                    ws.append((int(x), shape))
                    continue
                q = _best({y[0] for y in shape}, index)
                # A shape of no text has no slots.
                out.append(fit(k[0], sh, shape, *((ws[q][0], placed(ws[q][1], shape)) if q is not None else (0, [-1] * len(shape)))))
            yield frame(out, "host", "sh", "w", "slots", "ks", "paths")

    n = _shares(shapes)
    a = w.join(n, "host").select("host", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("salt"), F.lit(True).alias("first"), F.lit("").alias("sh"), F.col("wrapper").alias("s"), F.xxhash64("wrapper").alias("w"))
    d = a.union(shapes.join(n, "host").select("host", _salt(), F.lit(False), "sh", "s", F.lit(0).cast("long")))
    d = d.repartition("host", "salt").sortWithinPartitions("host", "salt", F.desc("first"), "s")
    return d.mapInPandas(run, "host string, sh string, w long, slots array<int>, ks array<int>, paths array<string>")


def _unplaced(fit: DataFrame) -> DataFrame:
    """(host, sh, path, k, ks): a shape's own slots that no wrapper has, by path; the first of them stands for all."""
    x = fit.select("host", "sh", F.explode(F.arrays_zip("ks", "paths")).alias("x"))
    return x.groupBy("host", "sh", F.col("x.paths").alias("path")).agg(F.min("x.ks").alias("k"), F.collect_list("x.ks").alias("ks"))


def evidence(parsed: DataFrame, fit: DataFrame, w: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, sh, template) with the constant texts of each shape's slots, and (host, over), the element whose name a host overrules.

    A text is shared where half of the distinct pages that have its slot have it there, PAGES at least.
    Slots that no wrapper has are one by their path, so that rare slots and layouts are judged likewise.
    It is template where as many are witnesses, their other text being mostly their own: so what
    reprints, mirrors and print views share is none, and what pages that are otherwise unlike share is.
    Of text that varies, in slots of two pages or more and outside OUT, an element named as noise is
    overruled if it holds over half of the host's, and elements of other names hold less than a fifth.
    """
    on = ["host", "w", "slot"]
    pages = parsed.select("host", "sh", "pk").distinct().groupBy("host", "sh").count()
    rest, by_path = _unplaced(fit), [F.xxhash64("path").alias("w"), F.lit(-1).alias("slot")]
    placed_ = fit.select("host", "w", "sh", F.posexplode("slots").alias("k", "slot")).where("slot >= 0")
    own = written(placed_.unionByName(rest.select("host", *by_path, "sh", F.explode("ks").alias("k"))))
    many = placed_.unionByName(rest.select("host", *by_path, "sh", "k")).join(pages, ["host", "sh"]).groupBy(on).agg(F.sum("count").alias("pages"))
    # Slots of one path that no wrapper has are one, so that a page counts once.
    same_slot = F.explode(F.transform("ks", lambda x: F.struct(x.alias("key"), F.col("k").alias("value")))).alias("x")
    first = written(rest.where(F.size("ks") > 1).select("host", "sh", same_slot).groupBy("host", "sh").agg(F.map_from_entries(F.collect_list("x")).alias("__first")))
    if not first.isEmpty():
        parsed = parsed.join(first, ["host", "sh"], "left").withColumn("slots", F.transform("slots", lambda k: F.coalesce(F.col("__first")[k], k))).drop("__first")
    block = F.transform(F.arrays_zip("slots", "hashes", "lengths"), lambda x: F.struct(x["slots"].alias("k"), x["hashes"].alias("h"), x["lengths"].alias("l")))
    seen = parsed.select("host", "sh", "pk", F.explode(F.array_distinct(block)).alias("b")).select("host", "sh", "pk", "b.*").distinct()
    seen = seen.groupBy("host", "sh", "k", "h").agg(F.count("*").alias("n"), F.max("l").alias("l"))
    texts = seen.join(own, ["host", "sh", "k"]).groupBy(*on, "h").agg(F.sum("n").alias("n"), F.max("l").alias("l")).join(many, on).where("pages > 1")
    same = (F.col("n") >= PAGES) & (2 * F.col("n") >= F.col("pages"))
    slots = written(texts.groupBy(on).agg(F.sum(F.when(~same, F.col("l") * F.col("n")).otherwise(0)).alias("v"), F.collect_list(F.when(same, F.struct("h", "n"))).alias("t")))
    def listed(t: DataFrame) -> DataFrame:
        x = own.join(t, on)
        return x.groupBy("host", "sh").agg(F.concat_ws(",", F.sort_array(F.collect_list(F.concat_ws(" ", "k", "h", "n")))).alias("template"))

    shared = slots.where(F.size("t") > 0).select(*on, F.explode("t").alias("t")).select(*on, "t.h", "t.n")

    @F.pandas_udf("array<struct<k:int,h:long>>")
    def witness(s: pd.Series, slots: pd.Series, hashes: pd.Series, lengths: pd.Series, template: pd.Series) -> pd.Series:
        return pd.Series([witnessed(*x) for x in zip(s, slots, hashes, lengths, template)], dtype=object)

    w2 = parsed.join(listed(shared), ["host", "sh"]).select("host", "sh", "pk", F.explode(witness("s", "slots", "hashes", "lengths", "template")).alias("x"))
    w2 = w2.select("host", "sh", "pk", "x.k", "x.h").distinct().groupBy("host", "sh", "k", "h").count()
    w2 = w2.join(own, ["host", "sh", "k"]).groupBy(*on, "h").agg(F.sum("count").alias("n")).join(many, on).where(same).drop("pages")
    part = F.split("path", r"\|")
    path = w.select("host", F.xxhash64("wrapper").alias("w"), F.posexplode(F.from_json("wrapper", "array<array<string>>")).alias("slot", "x")).select(*on, F.col("x")[0].alias("path"))
    path = path.unionByName(rest.select("host", *by_path, "path").distinct()).select(*on, F.when(part[1] == "0", part[2]).alias("e"))
    e = slots.join(path, on).where("e is not null").groupBy("host", "e").agg(F.sum("v").alias("v"))
    e = e.groupBy("host").agg(F.sum("v").alias("all"), F.sum(F.when(F.col("e") == "", F.col("v")).otherwise(0)).alias("clean"), F.max(F.when(F.col("e") != "", F.struct("v", "e"))).alias("top"))
    return listed(w2), e.where("2 * top.v > all and 5 * clean < all").select("host", F.col("top.e").alias("over"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars.

    Pages are parsed once and aligned with the wrappers of their host. Constant texts of a slot are
    template where pages that are otherwise unlike have them, what varies is main text by tags and names,
    where the host does not overrule a name; blocks are joined by a blank line in page order. Hosts of
    fewer than PAGES pages go by tags and names alone.
    Null html counts as empty and has empty text; a null or odd url is one host; equal pages of a
    host count once; repeated rows each give a row.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1)), F.lit(""))
    d = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("t"))

    def parse(batches):
        for b in batches:
            out = []
            for t in b["t"]:
                found, at = blocks(t), []
                for k, (p, _) in enumerate(found):
                    at.append(at[-1] + (p != found[k - 1][0]) if k else 0)
                out.append((json.dumps(folded([p for p, _ in found])), at, [x for _, x in found]))
            yield pd.DataFrame({"id": b["id"], "url": b["url"], "host": b["host"], "s": [x[0] for x in out], "slots": [x[1] for x in out], "texts": [x[2] for x in out]})

    d = d.mapInPandas(parse, f"id {dict(d.dtypes)['id']}, url string, host string, s string, slots array<int>, texts array<string>")
    d = d.withColumns({"sh": F.md5("s"), "pk": F.xxhash64("s", "texts"), "hashes": F.transform("texts", lambda x: F.xxhash64(x)), "lengths": F.transform("texts", lambda x: F.length(x))})
    d = written(d, "zstd")
    shapes = written(d.groupBy("host", "sh", "s").agg(F.count("*").alias("pages")))
    w = written(wrappers(shapes))
    fit = written(fitted(shapes, w))
    template, over = evidence(d, fit, w)
    known = written(fit.select("host", "sh").join(template, ["host", "sh"], "left").join(over, "host", "left"))

    @F.pandas_udf("string")
    def text(s: pd.Series, slots: pd.Series, texts: pd.Series, hashes: pd.Series, template: pd.Series, over: pd.Series) -> pd.Series:
        return pd.Series([main_text(*x) for x in zip(s, slots, texts, hashes, template, over)], dtype=object)

    d = d.join(known, ["host", "sh"], "left").withColumn("text", text("s", "slots", "texts", "hashes", "template", "over"))
    return d.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
