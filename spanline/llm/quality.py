"""Quality classifier: Bradley-Terry ranking of documents from preference pairs."""
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = 14


def features(text: str | None) -> np.ndarray:
    """Shape of a whole text: character classes, word lengths, repeats, lines; all bounded."""
    t = text or ""
    words = t.split()
    n, m = max(1, len(t)), max(1, len(words))
    code = np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32)
    ascii_ = np.bincount(np.minimum(code, 128), minlength=129) / n
    up, low, digit = ascii_[65:91].sum(), ascii_[97:123].sum(), ascii_[48:58].sum()
    odd = ascii_[33:48].sum() + ascii_[58:65].sum() + ascii_[91:97].sum() + ascii_[123:127].sum() - ascii_[44] - ascii_[46]
    same = sum(a == b for a, b in zip(words, words[1:])) / m
    lines = t.split("\n")
    return np.array([
        min(1, odd * 5), min(1, 20 * odd), min(1, up * 2), min(1, up / max(1e-9, up + low)), min(1, digit * 5), min(1, same), min(1, 5 * same),
        len(set(words)) / m, min(1, ascii_[124] * 20), min(1, ascii_[33] * 10), min(1, n / m / 12), min(1, np.log1p(m) / 10), len(set(lines)) / len(lines), min(1, 10 * ascii_[46]),
    ])


def fit(x: np.ndarray, y: np.ndarray, steps: int = 400, pairs: int = 60_000, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and threshold: logistic loss on feature differences of preferred and other documents.

    The threshold is the middle of the score quantiles that split the sample with the fewest errors, so that 0 is the cut.
    """
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(x.shape[1])
    if not len(good) or not len(bad):
        return w, 0.0 if len(good) or not len(bad) else 1.0
    rng = np.random.default_rng(7)
    d = x[rng.choice(good, pairs)] - x[rng.choice(bad, pairs)]
    scale = d.std(axis=0) + 1e-9
    d = d / scale
    for k in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        w += 2.0 * (d.T @ p / pairs - ridge * w)
    w = w / scale
    s = x @ w
    order = np.argsort(s)
    wrong = np.concatenate(([0], np.cumsum(np.where(y[order] == 1, 1, -1)))) + (y == 0).sum()
    k = int(np.mean(np.flatnonzero(wrong == wrong.min())))
    lo, hi = s[order[max(0, k - 1)]], s[order[min(len(s) - 1, k)]]
    return w, float((lo + hi) / 2)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000) -> tuple[np.ndarray, float]:
    """Fit on at most max_rows labelled ids, those with the smallest hash of their id.

    Of labels of one id the largest counts, of texts of one id the smallest, so that what comes to the driver is bounded by max_rows.
    """
    lab = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and id is not null")
    lab = lab.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_rows)

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "x": [features(t).tolist() for t in b["t"]]})

    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(lab), "id").groupBy("id", "y").agg(F.min("t").alias("t"))
    rows = sorted(d.mapInPandas(run, "y int, x array<double>").collect(), key=lambda r: (r.y, r.x))
    return fit(np.array([r.x for r in rows]).reshape(-1, FEATURES), np.array([r.y for r in rows]))


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", out: str = "score") -> DataFrame:
    """docs and a column `out`, 0 to 1: the logistic of the document's strength above the threshold."""
    w, cut = model

    @F.pandas_udf("double")
    def of(t: pd.Series) -> pd.Series:
        s = np.array([features(x) @ w - cut for x in t], float)
        return pd.Series(1 / (1 + np.exp(-np.clip(s, -30, 30))))

    return docs.withColumn(out, of(F.col(text_col)))


def held_out(id_col: str, parts: int, part: int):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 3, part: int = 1) -> DataFrame:
    """One row per document: id, held_out, score, predicted (score of 0.5 or more).

    Labels of held-out rows are never read. Null text is scored as empty; repeated rows each give a
    row; with labels of one kind only every document gets that kind's side; no labels: all score 0.5.
    """
    known = labels.where(~held_out(id_col, parts, part))
    model = train(docs.select(id_col, text_col), known, id_col, text_col)
    d = score(docs.select(F.col(id_col), F.col(text_col)), model, text_col, "score")
    return d.select(id_col, held_out(id_col, parts, part).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
