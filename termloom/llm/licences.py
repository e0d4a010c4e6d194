"""Licence scans by a positional index of rare words. Built-in functions only.

Words are runs of 0-9, a-z (after lower-casing A-Z) and non-ASCII characters. TEMPLATES are the notices,
headers and distinctive passages of common licences; the index holds postings (word, template,
position) of every template's words of highest inverse document frequency among the templates. For
each text its words of the index are looked up, and a posting says where its template would begin: the
word's position in the text less its position in the template. Where two different words of one
template agree in that to DRIFT words, the template is laid there: each of its words that stands within
DRIFT words of its place adds its weight. The score is the share of the weight found. A template is
reported where the score is at least MIN_SCORE, one of its mandatory key phrases stands there word for
word, and no negation does. So notices that are cut short or reworded in part are found, and a licence
that is only named, or said not to apply, is not. Base phrases are looked up exactly, at every place.

The index is a constant of some hundred words inside the plan; there is no shuffle. Only texts with the
first words of some key or base phrase are taken apart; for the others the words are just
counted. Work grows with a text's looked-up words, each of which is compared with its neighbours only.

Defined cases: null text is empty; repeated rows and rows with null doc_id are scanned each; of several
places of a template all are reported, ties included, and the score is the best one's; a text with a
base phrase scores 1; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Least share of a template's weight in thousandths; words that a place may be off.
MIN_SCORE, DRIFT = 600, 3
#: Looked-up words of a template, and of one with at most SHORT words.
ANCHORS, ANCHORS_SHORT, SHORT = 6, 3, 8

#: Base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Near a template, one of these means that the licence isn't granted.
NEGATIONS = ["do not apply", "does not apply", "don t apply", "doesn t apply", "did not apply", "no longer apply", "no longer applies", "not licensed under", "not released under", "not covered by", "not available under", "no longer licensed", "no longer released"]

#: Label, passage of the licence, mandatory key phrases (any one of them), all as words.
TEMPLATES = [
    ("mit", "released under the mit license", ["the mit license"]),
    ("mit", "licensed under the mit license", ["the mit license"]),
    ("mit", "the mit license mit copyright c", ["the mit license mit", "mit license copyright", "mit license mit copyright"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software", ["permission is hereby granted free of charge"]),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["to deal in the software without restriction", "publish distribute sublicense and or sell copies of the software"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["this permission notice shall be included in all copies"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["for any purpose with or without fee is hereby granted", "this software for any purpose with or without fee"]),
    ("isc", "provided that the above copyright notice and this permission notice appear in all copies", ["this permission notice appear in all copies"]),
    ("isc", "licensed under the isc license", ["the isc license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions", ["redistributions of source code must retain the above copyright notice"]),
    ("bsd-2", "released under the bsd 2 clause license", ["bsd 2 clause"]),
    ("bsd-3", "released under the bsd 3 clause license", ["bsd 3 clause"]),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["may be used to endorse or promote products derived from this software", "to endorse or promote products derived"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("apache-2", "licensed under the apache license 2 0", ["apache license 2 0"]),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["www apache org licenses license 2 0", "apache org licenses license 2 0"]),
    ("apache-2", "apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution", ["apache license version 2", "terms and conditions for use reproduction and distribution"]),
    ("apache-2", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of", ["perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu general public license as published by the free software foundation either version 3", "gnu general public license as published by the free software foundation version 3"]),
    ("gpl-2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["gnu general public license as published by the free software foundation either version 2", "gnu general public license as published by the free software foundation version 2"]),
    ("lgpl-3", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu lesser general public license as published by the free software foundation either version 3"]),
    ("lgpl-2.1", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", ["gnu lesser general public license as published by the free software foundation either version 2"]),
    ("agpl-3", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu affero general public license as published by the free software foundation either version 3"]),
    ("gpl-3", "gnu general public license version 3 29 june 2007", ["gnu general public license version 3"]),
    ("gpl-2", "gnu general public license version 2 june 1991", ["gnu general public license version 2"]),
    ("lgpl-3", "gnu lesser general public license version 3 29 june 2007", ["gnu lesser general public license version 3"]),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3", ["gnu lesser general public license version 3"]),
    ("lgpl-2.1", "gnu lesser general public license version 2 1 february 1999", ["gnu lesser general public license version 2 1"]),
    ("lgpl-2.1", "licensed under the gnu lesser general public license version 2 1", ["gnu lesser general public license version 2 1"]),
    ("agpl-3", "gnu affero general public license version 3 19 november 2007", ["gnu affero general public license version 3"]),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ["gnu affero general public license version 3"]),
    ("gpl", "you should have received a copy of the gnu general public license along with this program if not see", ["you should have received a copy of the gnu general public license"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"]),
    ("mpl-2", "licensed under the mozilla public license version 2 0", ["mozilla public license version 2 0"]),
    ("epl-2", "made available under the terms of the eclipse public license v 2 0", ["eclipse public license v 2 0", "eclipse public license 2 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ["free and unencumbered software released into the public domain"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    ("cc0", "licensed under cc0 1 0 universal public domain dedication", ["cc0 1 0"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike 4 0"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial 4 0"]),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license", ["creative commons attribution noderivatives 4 0"]),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ["any person or organization obtaining a copy of the software"]),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", ["in no event will the authors be held liable"]),
    ("all-rights-reserved", "all rights reserved", ["all rights reserved"]),
]


def _weights() -> dict[str, int]:
    """Inverse document frequency of every word of the templates, in thousandths."""
    df = Counter(w for _, text, _ in TEMPLATES for w in set(text.split()))
    return {w: round(1000 * math.log(1 + len(TEMPLATES) / n)) for w, n in df.items()}


def index() -> tuple[list[dict], dict[str, list[tuple[int, int]]]]:
    """(the templates with their weights, postings of the looked-up words: word to template and place)."""
    idf = _weights()
    out, postings = [], {}
    for t, (label, text, keys) in enumerate(TEMPLATES):
        words = text.split()
        weight = [idf[w] for w in words]
        out.append({"label": label, "words": words, "weight": weight, "total": sum(weight), "keys": keys})
        most = ANCHORS_SHORT if len(words) <= SHORT else ANCHORS
        for k in sorted(range(len(words)), key=lambda k: (-weight[k], k))[:most]:
            postings.setdefault(words[k], []).append((t, k))
    return out, postings


def needed() -> str:
    """A pattern without which a text holds no key phrase and no base phrase: the phrases' first words."""
    heads = {" ".join(p.split()[:3]) for p in [k for _, _, keys in TEMPLATES for k in keys] + list(PHRASES)}
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    return f"(?<![^{gap[1:-1]}])(?:{'|'.join(f'{gap}+'.join(f'(?i:{w})' for w in h.split()) for h in sorted(heads))})"


def _stretch(words: Column, lo: Column, hi: Column) -> Column:
    """The words from lo to hi, both included, of places that may lie outside, between blanks."""
    lo = F.greatest(lo, F.lit(0))
    own = F.slice(words, lo + 1, F.greatest(hi - lo + 1, F.lit(0)))
    return F.concat(F.lit(" "), F.array_join(own, " "), F.lit(" "))


def _holds(text: Column, phrases: Column) -> Column:
    return F.exists(phrases, lambda p: F.contains(text, F.concat(F.lit(" "), p, F.lit(" "))))


def _laid(words: Column, t: Column, c: Column) -> Column:
    """A candidate c(t, s) as (label, start, score in thousandths of its weight, what decides)."""
    s, n = c["s"], F.size(t["words"])
    places = F.sequence(F.lit(0), n - 1)

    def found(acc: Column, j: Column) -> Column:
        lo = F.greatest(s + j - DRIFT, F.lit(0))
        near = F.slice(words, lo + 1, F.greatest(s + j + DRIFT - lo + 1, F.lit(0)))
        return acc + F.when(F.array_contains(near, F.get(t["words"], j)), F.get(t["weight"], j)).otherwise(0)

    score = F.aggregate(places, F.lit(0), found)
    key = _holds(_stretch(words, s - DRIFT, s + n - 1 + DRIFT), t["keys"])
    negated = _holds(_stretch(words, s - DRIFT - 2, s + n + DRIFT + 2), F.array(*map(F.lit, NEGATIONS)))
    return F.struct(t["label"].alias("label"), s.alias("start"), (score / t["total"]).alias("score"), (key & ~negated & (1000 * score >= MIN_SCORE * t["total"])).alias("ok"))


def _candidates(events: Column) -> Column:
    """(t, s) of the places at which two different words of a template agree, from sorted distinct (t, s, p)."""
    at = lambda k: F.get(events, k)

    def agree(a: Column, b: Column) -> Column:
        return F.coalesce((a["t"] == b["t"]) & (a["p"] != b["p"]) & (F.abs(a["s"] - b["s"]) <= DRIFT), F.lit(False))

    own = F.filter(events, lambda e, k: agree(e, at(k - 1)) | agree(e, at(k + 1)))
    return F.array_distinct(F.transform(own, lambda e: F.struct(e["t"].alias("t"), e["s"].alias("s"))))


def _phrase_places(words: Column, found: Column, label: str, phrase: list[str]) -> Column:
    own = F.filter(found, lambda x: (x["w"] == phrase[0]) & (F.slice(words, x["i"] + 1, len(phrase)) == F.array(*map(F.lit, phrase))))
    return F.transform(own, lambda x: F.struct(F.lit(label).alias("label"), x["i"].cast("long").alias("i")))


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places) for
    every row of docs(doc_id, text); places are the templates found, with start and score."""
    templates, postings = index()
    constant = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)
    known = constant(templates, "array<struct<label:string,words:array<string>,weight:array<int>,total:int,keys:array<string>>>")
    lists = constant({w: [{"t": t, "p": p} for t, p in x] for w, x in postings.items()}, "map<string,array<struct<t:int,p:int>>>")
    df = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    may = F.col("_t").rlike(needed())
    df = df.withColumn("_w", F.when(may, F.regexp_extract_all(F.translate("_t", UPPER, LOWER), F.lit(WORD), F.lit(0))))
    n_words = F.when(F.col("_w").isNull(), F.regexp_count("_t", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))).otherwise(F.size("_w"))
    df = df.select("doc_id", n_words.cast("long").alias("n_words"), "_w")
    look = sorted({*postings, *(p.split()[0] for p in PHRASES)})
    df = df.withColumn("_f", F.filter(F.transform("_w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(look)))
    places = [_phrase_places(F.col("_w"), F.col("_f"), label, phrase.split()) for phrase, label in PHRASES.items()]
    df = df.withColumn("_b", F.coalesce(F.flatten(F.array(*places)), F.array().cast("array<struct<label:string,i:bigint>>")))
    starts = F.flatten(F.transform("_f", lambda x: F.transform(F.coalesce(F.try_element_at(lists, x["w"]), F.array().cast("array<struct<t:int,p:int>>")), lambda q: F.struct(q["t"].alias("t"), (x["i"] - q["p"]).alias("s"), q["p"].alias("p")))))
    df = df.withColumn("_e", F.array_sort(F.array_distinct(starts)))
    laid = F.transform(_candidates(F.col("_e")), lambda c: _laid(F.col("_w"), F.get(known, c["t"]), c))
    df = df.withColumn("_p", F.coalesce(F.filter(laid, lambda h: h["ok"]), F.array().cast("array<struct<label:string,start:int,score:double,ok:boolean>>")))
    first, base, own = F.col("_b")["i"], F.col("_b")["label"], F.col("_p")["label"]
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    score = F.when(F.size("_b") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.col("_p")["score"]), F.lit(0.0)))
    return df.select(
        "doc_id", "n_words", F.size("_b").cast("long").alias("n_base"), F.array_min(first).alias("first_word"), F.array_max(first).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"), score.alias("score"),
        F.transform("_p", lambda h: F.struct(h["label"].alias("label"), h["start"].alias("start"), h["score"].alias("score"))).alias("places"),
    )


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("places")


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def _sql() -> str:
    templates, postings = index()
    tw = [(t, j, w, x["weight"][j]) for t, x in enumerate(templates) for j, w in enumerate(x["words"])]
    base = "\n  union all ".join(
        f"select r, i, '{label}' as label from occ where w = '{p.split()[0]}' and list_slice(ws, i + 1, i + {len(p.split())}) = {p.split()}" for p, label in PHRASES.items()
    )
    return rf"""
with post(w, t, p) as (values {_values([(w, t, p) for w, x in postings.items() for t, p in x])}),
tpl(t, label, total, n) as (values {_values([(t, x["label"], x["total"], len(x["words"])) for t, x in enumerate(templates)])}),
tw(t, j, w, weight) as (values {_values(tw)}),
keys(t, k) as (values {_values([(t, k) for t, x in enumerate(templates) for k in x["keys"]])}),
neg(k) as (values {_values([(k,) for k in NEGATIONS])}),
d as materialized (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as ws from documents),
occ as materialized (select * from (select r, ws, unnest(ws) as w, unnest(range(len(ws))) as i from d) where w in (select w from post) or w in ({", ".join(f"'{p.split()[0]}'" for p in PHRASES)})),
base as materialized ({base}),
ev as (select distinct r, t, i - p as s, p from occ join post using (w)),
near as (select *, lag(s) over o as s0, lag(p) over o as p0, lead(s) over o as s1, lead(p) over o as p1 from ev window o as (partition by r, t order by s, p)),
cand as (select distinct r, t, s from near where (p0 <> p and s - s0 <= {DRIFT}) or (p1 <> p and s1 - s <= {DRIFT})),
laid as (select c.r, c.t, c.s, any_value(d.ws) as ws, sum(weight) filter (list_contains(list_slice(d.ws, greatest(s + j - {DRIFT}, 0) + 1, s + j + {DRIFT} + 1), w)) as matched
  from cand c join d on d.r = c.r join tw on tw.t = c.t group by all),
text as (select l.r, l.t, matched, label, total, ' ' || array_to_string(list_slice(ws, greatest(s - {DRIFT}, 0) + 1, greatest(s + n + {DRIFT}, 0)), ' ') || ' ' as x,
  ' ' || array_to_string(list_slice(ws, greatest(s - {DRIFT + 2}, 0) + 1, greatest(s + n + {DRIFT + 3}, 0)), ' ') || ' ' as y from laid l join tpl on tpl.t = l.t),
ok as (select r, label, cast(matched as double) / total as score from text where 1000 * matched >= {MIN_SCORE} * total
  and exists (select 1 from keys where keys.t = text.t and contains(x, ' ' || k || ' ')) and not exists (select 1 from neg where contains(y, ' ' || k || ' '))),
b as (select r, count(*) as n_base, min(i) as first_word, max(i) as last_word, string_agg(distinct label, ',' order by label) as base_labels from base group by r),
m as (select r, string_agg(distinct label, ',' order by label) as labels from (select r, label from base union all select r, label from ok) group by r),
best as (select r, max(score) as score from ok group by r)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base, cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, case when n_base > 0 then 1.0::double else coalesce(score, 0.0::double) end as score
from d left join b on b.r = d.r left join m on m.r = d.r left join best on best.r = d.r
"""


OP3_SQL = _sql()
