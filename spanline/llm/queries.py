"""The operators' queries over the given tables, and their SQL where SQL can express them."""
from . import decontaminate, exact_dedup, fim, html, language, licenses, mixing, negatives, quality, simhash, substrings, tokens, topk


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


QUERIES = {
    "op1_decontaminate": lambda s, d: decontaminate.leaks(_read(s, d, "documents"), _read(s, d, "benchmark")),
    "op2_language": lambda s, d: language.identify(_read(s, d, "documents")),
    "op3_substring_dedup": lambda s, d: substrings.repeats(_read(s, d, "documents")),
    "op4_licenses": lambda s, d: licenses.scan(_read(s, d, "documents")),
    "op5_html": lambda s, d: html.extract(_read(s, d, "pages")),
    "op10_tokens": lambda s, d: tokens.count(_read(s, d, "documents")),
    "op6_simhash": lambda s, d: simhash.near_groups(_read(s, d, "documents")),
    "op7_quality": lambda s, d: quality.classify(_read(s, d, "documents"), _read(s, d, "labels")),
    "op8_mixing": lambda s, d: mixing.mix(_read(s, d, "documents")),
    "op9_exact_dedup": lambda s, d: exact_dedup.exact_groups(_read(s, d, "documents")),
    "op11_topk": lambda s, d: topk.search(_read(s, d, "embeddings")),
    "op12_fim": lambda s, d: fim.digests(_read(s, d, "documents")),
    "op13_negatives": lambda s, d: negatives.mine(_read(s, d, "embeddings")),
}
SQL = {
    "op11_topk": topk.SQL,
    "op12_fim": fim.SQL,
    "op13_negatives": negatives.SQL,
    "op8_mixing": mixing.SQL,
    "op9_exact_dedup": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256 FROM d WINDOW w AS (PARTITION BY t)""",
}
