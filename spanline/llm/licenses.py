"""License scans by a positional rare-token index; DataFrame functions only."""
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RARE_WORDS, LEAST_SHARE = 3, 0.5
#: Label, words of the notice, key phrases that must stand at their place, and whether it is a base phrase.
TEMPLATES = [
    ("cc-by", "cc by", ["cc by"], True),
    ("gpl", "general public license", ["general public license"], True),
    ("reserved", "all rights reserved", ["all rights reserved"], True),
    ("mit", "released under the mit license", ["mit license"], False),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted free of charge"], False),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2"], False),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license version 3"], False),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4"], False),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use in source and binary forms"], False),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"], False),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["this source code form is subject to the terms of", "mozilla public license v 2 0"], False),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["above copyright notice and this permission notice shall be included", "substantial portions of the software"], False),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license version 2 0", "except in compliance with the license"], False),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify", "with or without fee is hereby granted"], False),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["neither the name of", "may be used to endorse or promote products", "without specific prior written permission"], False),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license", "free software foundation"], False),
    ("agpl-3.0", "under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license", "free software foundation"], False),
    ("gpl", "it under the terms of the gnu general public license as published by the free software foundation", ["terms of the gnu general public license", "free software foundation"], False),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software", "public domain"], False),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["to the extent possible under law", "waived all copyright and related or neighboring rights"], False),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0 international license"], False),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike 4 0 international license"], False),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["without any express or implied warranty", "in no event will the authors be held liable"], False),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ["boost software license version 1 0"], False),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", ["terms of the eclipse public license"], False),
]


def _words(text_col: str):
    low = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(WORDS), F.lit(0))


def _literal(rows: list, kind: str):
    """A constant array of structs."""
    import json

    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The index holds each template's RARE_WORDS words of highest IDF, counted over all documents, with
    their positions. A file's rare licence words are looked up; each posting gives the place where the
    template would start; the places are intersected by relative position, and kept where the key
    phrases stand and LEAST_SHARE of the IDF of the template's rare words agrees. All work is local to
    a row: nothing but the licence words' counts (as many rows as words in the templates) is shuffled.
    Null and empty texts have no words; score is the largest share, 0 without a licence; repeated
    rows each give a row; an empty table gives no rows.
    """
    d = docs.select(F.col(id_col).alias("id"), _words(text_col).alias("w"))
    notices = [t[1].split() for t in templates]
    vocab = sorted({w for n in notices for w in n})
    seen = d.select(F.explode(F.concat(F.array(F.lit("")), F.array_distinct(F.filter("w", lambda x: x.isin(vocab))))).alias("w"))
    df = {r[0]: r[1] for r in seen.groupBy("w").count().collect()}
    idf = {w: math.log((1 + df.get("", 0)) / (1 + df.get(w, 0))) + 1e-3 for w in vocab}
    posts, total = [], []
    for t, n in enumerate(notices):
        rare = sorted(set(n), key=lambda w: (-idf[w], w))[:RARE_WORDS]
        at = [(w, p) for p, w in enumerate(n) if w in rare]
        total.append(sum(idf[w] for w, _ in at))
        posts += [{"w": w, "t": t, "p": p, "share": idf[w] / total[t]} for w, p in at]
    index = {w: [p for p in posts if p["w"] == w] for w in {p["w"] for p in posts}}
    hits = F.filter(F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["x"].isin(list(index)))
    postings = _literal(posts, "w:string,t:int,p:int,share:double")
    d = d.withColumn("n_words", F.size("w").cast("long")).withColumn("hits", hits)
    # Of a row only what follows a hit is looked at again.
    d = d.withColumn("at", F.flatten(F.transform("hits", lambda s: F.transform(F.filter(postings, lambda p: p["w"] == s["x"]), lambda p: F.struct(p["t"].alias("t"), (s["i"] - p["p"]).alias("a"), p["share"].alias("share"))))))

    def verified(x):
        ok = F.lit(False)
        for t, (_, _, phrases, _) in enumerate(templates):
            here = x["t"] == t
            for ph in phrases:
                ph = ph.split()
                off = next(o for o in range(len(notices[t])) if notices[t][o : o + len(ph)] == ph)
                for k, word in enumerate(ph):
                    here = here & (F.get("w", x["a"] + off + k) == word)
            ok = ok | F.coalesce(here, F.lit(False))
        return ok

    # Sorted by template and place, a place's postings are neighbours, no more than its template has: each
    # posting takes up the shares of so many after it, and the first of its place stands for it.
    d = d.withColumn("at", F.array_sort(F.filter("at", verified)))
    place = lambda x: F.struct(x["t"].alias("t"), x["a"].alias("a"))
    most = max(sum(p["t"] == t for p in posts) for t in range(len(templates)))
    sums = F.col("at")
    for j in range(1, most):
        more = lambda x, y: F.when(place(y) == place(x), y["share"]).otherwise(0.0)
        sums = F.zip_with(sums, F.slice("at", j + 1, F.size("at")), lambda x, y: F.struct(x["t"].alias("t"), x["a"].alias("a"), (x["share"] + F.coalesce(more(x, y), F.lit(0.0))).alias("share")))
    before = F.concat(F.array(F.lit(None).cast("struct<t:int,a:int,share:double>")), F.slice("at", 1, F.greatest(F.size("at") - 1, F.lit(0))))
    first = F.zip_with(sums, before, lambda x, y: F.struct(x["t"].alias("t"), x["a"].alias("a"), F.when(y["t"].isNull() | (place(y) != place(x)), x["share"]).alias("s")))
    d = d.withColumn("places", F.filter(first, lambda u: u["s"] >= LEAST_SHARE)).drop("w", "hits", "at")
    base = [t for t, x in enumerate(templates) if x[3]]
    d = d.withColumn("base", F.filter("places", lambda u: u["t"].isin(base)))
    name = F.array(*[F.lit(t[0]) for t in templates])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda u: F.get(name, u["t"])))), ",")
    starts = F.transform("base", lambda u: u["a"])
    return d.select(
        F.col("id").alias(id_col), "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        joined("base").alias("base_labels"), joined("places").alias("labels"), F.when(F.size("places") > 0, F.round(F.least(F.array_max(F.transform("places", lambda u: u["s"])), F.lit(1.0)), 6)).otherwise(0.0).alias("score"),
    )
