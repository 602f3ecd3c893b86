"""SimHash near-dedup by a segment-popcount embedding."""
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, hot_join, written

TILE, RADIUS, GROUPS, SAME = 256, 3, 6, 3
#: 64 bits in six groups of whole 2-bit segments.
WIDTHS = (12, 10, 10, 10, 10, 12)


def simhash(text: str | None, n: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the n-word shingles of a whole text; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    body, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    n = min(n, len(words))
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - n + 1].tolist()
    stops = (ends[n - 1 :] - 1).tolist()
    ones, h64 = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, len(starts), 32768):
        h = np.array([h64(body[a:b], seed) for a, b in zip(starts[k : k + 32768], stops[k : k + 32768])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp) with the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "fp": np.array([simhash(t) for t in b["t"]], np.uint64).view(np.int64)})

    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return d.mapInPandas(run, f"id {dict(d.dtypes)['id']}, fp long")


def _embedded(fp):
    """Bit counts of the 32 two-bit segments, packed in one long."""
    fives = F.lit(0x5555555555555555)
    a, b = fp.bitwiseAND(fives), F.shiftrightunsigned(fp, 1).bitwiseAND(fives)
    return a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def _forest(fp: np.ndarray, radius: int) -> list[tuple]:
    """Edges that connect what is linked among the fingerprints of one group."""
    out, seen = [], np.zeros(len(fp), bool)
    seg = np.uint64(0x5555555555555555)
    emb = (fp & seg) + ((fp >> np.uint64(1)) & seg)
    for root in range(len(fp)):
        if seen[root]:
            continue
        seen[root], todo = True, [root]
        while todo:
            i = todo.pop()
            d = emb ^ emb[i]
            low, high = d & seg, (d >> np.uint64(1)) & seg
            manhattan = np.bitwise_count(low) + 2 * np.bitwise_count(high & ~low)
            near = np.flatnonzero((manhattan <= radius) & ~seen)
            near = near[np.bitwise_count(fp[near] ^ fp[i]) <= radius]
            seen[near] = True
            out += [(fp[i], fp[j]) for j in near]
            todo += near.tolist()
    return out


def _masks() -> tuple[list[int], list[list[int]]]:
    """Bits of each grid's three groups, and, for each grid, of the choices of three of the six halves of its other groups."""
    groups, at = [], 0
    for n in WIDTHS:
        groups.append((at, n))
        at += n
    bits = lambda a, n: ((1 << n) - 1) << a
    grids, finer = [], []
    for c in combinations(range(GROUPS), SAME):
        grids.append(sum(bits(*groups[i]) for i in c))
        halves = [bits(*h) for i in range(GROUPS) if i not in c for h in ((groups[i][0], groups[i][1] // 2), (groups[i][0] + groups[i][1] // 2, groups[i][1] - groups[i][1] // 2))]
        finer.append([sum(x) for x in combinations(halves, SAME)])
    return grids, finer


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b) that connect all distinct fingerprints of column fp within `radius` bits.

    Fingerprints within 3 bits are within Manhattan distance 3 in the space of segment counts, so of
    six groups of segments three at least have equal counts: each choice of three is a grid and the
    counts in them a cell. A cell of over `tile` members is split by the bits of its three groups (of
    a linked pair, some choice has equal bits, thus equal counts, so this loses none and copies
    nothing); one that is still larger by the bits of three of the six halves of its other groups,
    which leaves 16 bits and so at most 65,536 members at any number of fingerprints. Those are dealt
    as pairs of tiles. A group is verified by the lower bound, then by the exact distance, and gives a
    spanning forest of its links rather than all pairs.
    """
    if not 0 <= radius <= GROUPS - SAME:
        raise ValueError("the grids hold for a radius of 0 to 3")
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    grids, finer = _masks()
    mask = F.array(*[F.lit(signed(m)) for m in grids])
    cell = fps.select("fp", _embedded(F.col("fp")).alias("e"), F.posexplode(mask).alias("g", "m")).select("fp", F.col("g").cast("byte").alias("g"), F.xxhash64("g", F.col("e").bitwiseAND(F.col("m"))).alias("c"))
    groups, level = [], written(cell)
    bits = lambda m: F.col("fp").bitwiseAND(m)
    for split in (lambda x: x.withColumn("c", F.xxhash64("c", bits(F.get(mask, F.col("g").cast("int"))))), lambda x: x.withColumn("m", F.explode(F.get(F.array(*[F.array(*[F.lit(signed(m)) for m in ms]) for ms in finer]), F.col("g").cast("int")))).select("fp", "g", F.xxhash64("c", "m", bits(F.col("m"))).alias("c")), None):
        full = written(level.groupBy("c").agg(F.count("*").alias("n")).where("n > 1"))
        small = level.join(full.where(F.col("n") <= tile).select("c"), "c").select("c", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp")
        groups.append(small)
        big = full.where(F.col("n") > tile)
        if split is None:
            x = level.join(big.select("c", F.ceil(F.col("n") / tile).cast("int").alias("nt")), "c").withColumn("t", F.pmod(F.xxhash64("fp"), F.col("nt")).cast("int"))
            x = x.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("nt") - 1)))
            groups.append(x.select("c", F.least("t", "u").alias("i"), F.greatest("t", "u").alias("j"), "fp"))
            break
        if big.isEmpty():
            break
        level = written(split(level.join(big.select("c"), "c")))

    def run(batches):
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            key = b[["c", "i", "j"]].to_numpy()
            cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            rest, edges = b.iloc[cut[-1] if len(cut) else 0 :], []
            fp = b["fp"].to_numpy().view(np.uint64)
            for s, e in zip([0, *cut[:-1]], cut):
                edges += _forest(fp[s:e], radius)
            yield pd.DataFrame(np.array(edges, np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])
        if rest is not None and len(rest):
            edges = _forest(rest["fp"].to_numpy().view(np.uint64), radius)
            yield pd.DataFrame(np.array(edges, np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])

    x = reduce(DataFrame.union, groups)
    return x.repartition("c", "i", "j").sortWithinPartitions("c", "i", "j").mapInPandas(run, "a long, b long").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Null text counts as empty and has fingerprint zero; repeated rows each give a row; null ids are
    passed over for component_id unless a component has no other; an empty table gives no rows.
    """
    f = written(fingerprints(docs, id_col, text_col))
    least = written(f.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("n")))
    comp = components(links(least.select("fp"), radius)).toDF("fp", "label")
    x = least.join(comp, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    low = x.groupBy("label").agg(F.min("low").alias("component_id"))
    ids = written(x.join(low, "label").select("fp", "component_id", "n"))
    return hot_join(f, ids, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
