"""Fill-in-middle transformation: an indexable skip list turns cut ranks into places of the text."""
import re
from array import array

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN, PLAIN_FROM, SPM_BELOW = 64, 90, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
_RUN = re.compile(rf"(?>[A-Za-z]+|[^A-Za-z]){{1,{FAN}}}+")


class SkipList:
    """The units of a text in lanes; a node of lane k spans FAN^k units and holds its width in units and in code points.

    The text itself is the base lane, so that memory is a FAN-th of its units. Built from left to
    right in one pass; a rank is found by descending with accumulated widths, FAN steps a lane.
    """

    def __init__(self, text: str):
        self.text, units, chars = text, array("q"), array("q")
        for m in _RUN.finditer(text):
            units.append(FAN)
            chars.append(m.end() - m.start())
        if units:
            units[-1] = sum(1 for _ in _UNIT.finditer(text, len(text) - chars[-1]))
        self.size, self.lanes = sum(units), [(units, chars)]
        while len(units) > FAN:
            units, chars = (array("q", [sum(x[k : k + FAN]) for k in range(0, len(x), FAN)]) for x in (units, chars))
            self.lanes.append((units, chars))

    def place(self, rank: int) -> int:
        """Code points before the unit of this rank (from 0); the text's length for rank `size`."""
        at, node = 0, 0
        for units, chars in reversed(self.lanes):
            node *= FAN
            while node < len(units) and units[node] <= rank:
                rank, at, node = rank - units[node], at + chars[node], node + 1
        for m in _UNIT.finditer(self.text, at):
            if not rank:
                break
            rank, at = rank - 1, m.end()
        return at


def arranged(text: str, h: list[int]) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of a text and its four numbers."""
    units = SkipList(text)
    n = units.size
    if not text or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= PLAIN_FROM:
        return n, "plain", None, None, text
    a, b = (units.place(r) for r in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < SPM_BELOW:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1") -> DataFrame:
    """One row per input row: id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output.

    Cuts and forms come from the hash of seed and id, so reruns and repeated rows agree; a null id
    hashes as the seed alone. Null text counts as empty and is plain, as is text that holds a
    sentinel; an empty table gives no rows; other columns are ignored. Each text is one row of one
    task, read once.
    """
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    d = docs.select(F.col(id_col).alias("id"), key.alias("h"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))

    def run(batches):
        for b in batches:
            got = [arranged(t, [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]) for t, h in zip(b["t"], b["h"])]
            n, form, a, m, out = zip(*got) if got else [()] * 5
            whole = lambda x: pd.array(x, dtype="Int64")
            yield pd.DataFrame({"id": b["id"], "n": whole(n), "form": pd.Series(form, dtype=object), "prefix_chars": whole(a), "middle_chars": whole(m), "output": pd.Series(out, dtype=object)})

    d = d.mapInPandas(run, f"id {dict(d.dtypes)['id']}, n long, form string, prefix_chars long, middle_chars long, output string")
    return d.withColumnRenamed("id", id_col)


def restored(form: Column, output: Column) -> Column:
    """The text that output was made of: sentinels stand nowhere in a text that is cut, so the first of each is the mark."""
    p, s, m = PREFIX, SUFFIX, MIDDLE
    psm = F.regexp_replace(output, f"(?s)^{p}(.*?){s}(.*?){m}(.*)$", "$1$3$2")
    spm = F.regexp_replace(output, f"(?s)^{s}(.*?){p}(.*?){m}(.*)$", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """transform() with hashes of the output and of the text rebuilt from it in place of the texts."""
    d = transform(docs)
    return d.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
x AS (SELECT doc_id, t, u, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
