"""License scans with a positional rare-token index, in DataFrame operations only.

The index is built from short license templates: every template word gets an inverse document frequency
over the templates, and the rarest positions of each are posted. For each file all the licence words it
contains are looked up and their postings intersected by relative
position: postings that agree on (template, file position - template position) vote for one place. A template
with enough votes at one place is verified by its mandatory key phrases, which must stand inside that place. The whole scan is a
projection of the row, linear in its words: no shuffle, no join, and the index (a few hundred postings) is a literal of the plan.

Besides, three base phrases are counted wherever their words stand consecutively.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
CHAR = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: (label, template, mandatory key phrases)
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2")),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted", "free of charge")),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-3.0", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "version 3")),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("gpl-2.0", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "version 2")),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ("affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd 4 0",)),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc0", "dedicated to the public domain under cc0 1 0", ("cc0 1 0",)),
    ("mit", "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", ("to whom the software is furnished to do so",)),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("this permission notice shall be included",)),
    ("apache-2.0", "apache license version 2 0 january 2004", ("apache license version 2 0",)),
    ("apache-2.0", "you may not use this file except in compliance with the license", ("except in compliance with the license",)),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("unless required by applicable law or agreed to in writing",)),
    ("gpl-3.0", "gnu general public license version 3 29 june 2007", ("general public license", "version 3 29 june 2007")),
    ("gpl-2.0", "gnu general public license version 2 june 1991", ("general public license", "version 2 june 1991")),
    ("lgpl", "redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser general public license",)),
    ("lgpl", "gnu library general public license", ("gnu library general public license",)),
    ("agpl-3.0", "redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ("affero general public license", "version 3")),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistributions of source code must retain the above copyright notice",)),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions in binary form must reproduce the above copyright notice",)),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("may be used to endorse or promote products derived from this software",)),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("anyone is free to copy modify publish use compile sell or distribute this software",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable",)),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", ("altered source versions must be plainly marked as such",)),
    ("bsl-1.0", "boost software license version 1 0 august 17th 2003", ("boost software license",)),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ("boost software license",)),
    ("epl-2.0", "made available under the terms of the eclipse public license v 2 0", ("eclipse public license v 2 0",)),
    ("mpl-2.0", "mozilla public license version 2 0", ("mozilla public license version 2 0",)),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", ("sil open font license",)),
    ("artistic-2.0", "licensed under the artistic license 2 0", ("artistic license 2 0",)),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", ("cc by nc sa 4 0",)),
    ("cc-by-nc-nd-4.0", "licensed under cc by nc nd 4 0", ("cc by nc nd 4 0",)),
    ("cc-by-nc-4.0", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial 4 0",)),
    ("cc-by-nd-4.0", "licensed under a creative commons attribution noderivatives 4 0 international license", ("creative commons attribution noderivatives 4 0",)),
    ("cc-by-nc-sa-4.0", "licensed under a creative commons attribution noncommercial sharealike 4 0 international license", ("creative commons attribution noncommercial sharealike 4 0",)),
    ("cc-by-3.0", "licensed under cc by 3 0", ("cc by 3 0",)),
    ("cc-by-sa-3.0", "licensed under cc by sa 3 0", ("cc by sa 3 0",)),
    ("odbl-1.0", "made available under the open database license", ("open database license",)),
)
#: Words of everyday prose, of little use to rule texts out.
_PLAIN = frozenset("a above all and any anyone applicable as at be binary by charge copies copy copyright do except fee following for form forms free hereby held in included is it july june law list may modify must name no notice of on open or original permission place public publish purpose sell shall software source such the this to under use version will with without writing".split())
RAREST, AGREE = 6, 0.75


def build_index(templates=TEMPLATES) -> tuple[dict[str, float], dict[str, list[tuple[int, int]]], list[int]]:
    """IDF of every indexed word, its postings (template, position), and the number of posted positions per template."""
    split = [t.split() for _, t, _ in templates]
    df = Counter(w for words in split for w in set(words))
    idf = {w: log((1 + len(split)) / n) for w, n in df.items()}
    postings: dict[str, list[tuple[int, int]]] = {}
    posted = []
    for t, words in enumerate(split):
        rare = sorted(range(len(words)), key=lambda p: (-idf[words[p]], p))[:RAREST]
        posted.append(len(rare))
        for p in rare:
            postings.setdefault(words[p], []).append((t, p))
    return {w: idf[w] for w in postings}, postings, posted


def stems(choices: list[set[str]]) -> list[str]:
    """A small set of words of which each choice has one, greedily."""
    out: list[str] = []
    while left := [c for c in choices if not c & set(out)]:
        out.append(max(sorted(set().union(*left)), key=lambda w: (w not in _PLAIN, sum(w in c for c in left), len(w))))
    return out


def _has_any(lowered: Column, words: list[str]) -> Column:
    found = [F.contains(lowered, F.lit(w)) for w in words]
    return F.lit(False) if not found else reduce(lambda a, b: a | b, found)


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else re.escape(c) for c in word)


def _trie(words: list[str]) -> str:
    """A regular expression for the words, sharing prefixes."""
    heads: dict[str, list[str]] = {}
    for w in sorted(words):
        heads.setdefault(w[:1], []).append(w[1:])
    end = "" in heads
    heads.pop("", None)
    if not heads:
        return ""
    body = "|".join(_any_case(h) + _trie(rest) for h, rest in sorted(heads.items()))
    return f"(?:{body})" + ("?" if end else "")


def _whole(pattern: str) -> str:
    return f"(?<!{CHAR}){pattern}(?!{CHAR})"


BASE_PATTERN = _whole("(?:" + "|".join(f"{GAP}+".join(map(_any_case, p.split())) for p, _ in BASE) + ")")


def _n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{CHAR}+"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null text is empty: no words, no labels ('' in both columns), null first and last word, score 0. Base phrases never overlap, so all their
    places are counted. Score is the greatest share of a verified template's posted words found in place; 0.5 where
    only base phrases are found. Other columns are ignored; repeated rows are scanned each; an empty table gives none.
    """
    idf, postings, posted = build_index(templates)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    # No label without one of its mandatory words: a plain substring search, on a lower-cased copy, rules most texts out
    # before any costlier pattern runs. Lower-casing beyond A-Z can only let more texts through.
    d = d.withColumn("n_words", _n_words(F.col("t")).cast("long")).withColumn("_l", F.lower("t"))
    likely = _has_any(F.col("_l"), stems([set(p.split()) for p, _ in BASE]))
    d = d.withColumn("n_base", F.when(likely, F.regexp_count("t", F.lit(BASE_PATTERN))).otherwise(0).cast("long"))
    d = d.withColumn("_gate", _has_any(F.col("_l"), stems([{w for k in ks for w in k.split() if not w.isdigit()} for _, _, ks in templates])) & F.col("t").rlike(_whole(_trie(list(idf)))))

    some = F.col("n_base") > 0
    pieces, places = F.split("t", BASE_PATTERN, -1), F.regexp_extract_all("t", F.lit(BASE_PATTERN), F.lit(0))
    d = d.withColumn("first_word", F.when(some, _n_words(F.element_at(pieces, 1)).cast("long")))
    d = d.withColumn("last_word", F.when(some, F.col("n_words") - _n_words(F.element_at(pieces, -1)) - _n_words(F.element_at(places, -1))))
    first = F.transform(places, lambda m: F.lower(F.substring(m, 1, 1)))
    base = F.array_sort(F.array_distinct(F.transform(first, lambda c: F.when(c == "c", "cc-by").when(c == "g", "gpl").otherwise("reserved"))))
    none = F.array().cast("array<string>")
    d = d.withColumn("_base", F.when(some, base).otherwise(none))

    lower = F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    d = d.withColumn("_w", F.when(F.col("_gate"), F.regexp_extract_all(lower, F.lit(f"{CHAR}+"), F.lit(0))).otherwise(none))
    known = sorted(idf)
    post = F.create_map(*[x for w in known for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in postings[w]]))])
    hits = F.filter(F.transform("_w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: h["w"].isin(*known))
    d = d.withColumn("_h", hits)
    votes = F.flatten(F.transform("_h", lambda h: F.transform(F.element_at(post, h["w"]), lambda q: F.struct(q["t"].alias("t"), (h["i"] - q["p"]).alias("at")))))
    d = d.withColumn("_v", F.array_sort(votes))
    need = F.array(*[F.lit(max(1, ceil(AGREE * n))) for n in posted])
    full = F.array(*[F.lit(float(n)) for n in posted])
    length = F.array(*[F.lit(len(t.split())) for _, t, _ in templates])
    same = lambda v, i: F.coalesce(F.get("_v", i) == v, F.lit(False))
    # Sorted votes of one place stand together: where a run of enough of them begins, a place is found.
    runs = F.filter(F.transform("_v", lambda v, i: F.struct(v["t"].alias("t"), v["at"].alias("at"), v.alias("v"), i.alias("i"))), lambda r: same(r["v"], r["i"] + F.get(need, r["v"]["t"]) - 1) & ~same(r["v"], r["i"] - 1))
    found = F.transform(runs, lambda r: F.struct(r["t"].alias("t"), r["at"].alias("at"), reduce(lambda x, y: x + y, [same(r["v"], r["i"] + k).cast("int") for k in range(RAREST)]).alias("n")))
    d = d.withColumn("_p", found)
    keys = F.array(*[F.array(*[F.lit(f" {k} ") for k in ks]) for _, _, ks in templates])

    def words_of(p: Column) -> Column:
        own = F.slice("_w", F.greatest(p["at"], F.lit(0)) + 1, F.get(length, p["t"]) + F.least(p["at"], F.lit(0)))
        return F.concat(F.lit(" "), F.array_join(own, " "), F.lit(" "))

    placed = F.transform("_p", lambda p: F.struct(p["t"].alias("t"), p["n"].alias("n"), words_of(p).alias("own")))
    d = d.withColumn("_c", F.filter(placed, lambda p: F.forall(F.get(keys, p["t"]), lambda k: F.contains(p["own"], k))))
    names = F.array(*[F.lit(n) for n, _, _ in templates])
    labels = F.array_sort(F.array_distinct(F.concat("_base", F.transform("_c", lambda p: F.get(names, p["t"])))))
    best = F.array_max(F.transform("_c", lambda p: p["n"] / F.get(full, p["t"])))
    score = F.when(F.size("_c") > 0, best).when(some, 0.5).otherwise(0.0)
    return d.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def op2_license_scan(spark, sf_dir):
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
