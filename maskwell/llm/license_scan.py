"""License scans by a positional rare-token index, in DataFrame functions only.

The index holds the postings (template, position) of each template's rare word: one pass counts, over all documents, how many
hold each word of the templates' mandatory key phrases, and the word of highest inverse document frequency is the one a
template is found by. A template only matches where its whole key phrase stands, so a file that can match holds that word,
whatever else it holds. Each file's words are looked up once, all templates together; the postings of a hit give the place
where each of its templates would start; the key phrase is verified there word for word, and the rest of the template by the
share of its words that stand where they should. The choice of rare words moves cost and never a result. Whole licence texts
and single sentences are templates alike, and so are the base phrases, which are nothing but a key phrase.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import bind

_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that label a text wherever their words stand consecutively.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


@dataclass(frozen=True)
class Template:
    """``text``: the template's words; ``key``: words within it that must stand as they are."""

    label: str
    text: str
    key: str

    @property
    def key_at(self) -> int:
        own, key = self.text.split(), self.key.split()
        return next(i for i in range(len(own)) if own[i : i + len(key)] == key)


#: Well-known sentences of licences and licence notices, as lower-case words.
TEMPLATES = (
    Template("mit", "released under the mit license", "the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge to any person obtaining a copy"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    Template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "distribute this software for any purpose with or without fee"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    # whole texts
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense",
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "and the author disclaims all warranties with regard to this software",
    ),
    Template(
        "bsd-2-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "redistributions of source code must retain the above copyright notice",
    ),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
        "permission is granted to anyone to use this software for any purpose including commercial applications",
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "anyone is free to copy modify publish use compile sell or distribute this software",
    ),
    Template(
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "you may not use this file except in compliance with the license",
    ),
)
#: Share of a template's words that must stand in place.
COVERAGE = 0.7


def licence_words(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, runs of digits, letters and anything beyond ASCII."""
    return F.filter(F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), _NOT_WORD), lambda w: w != "")


def document_frequencies(df: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text_col: str = "text") -> tuple[int, dict[str, int]]:
    """Number of documents, and of those that hold each word of the key phrases: a few dozen counts over all rows."""
    vocabulary = sorted({w for t in templates for w in t.key.split()})
    text = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    # a text without any of the key phrases' long words can only hold short, common ones; these are counted alike
    held = F.array_intersect(F.split(text, _NOT_WORD), F.array(*map(F.lit, vocabulary)))
    row = df.select(held.alias("held")).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.array_contains("held", w)).alias(f"w{i}") for i, w in enumerate(vocabulary))).first()
    return row["n"], {w: row[f"w{i}"] for i, w in enumerate(vocabulary)}


def anchors(n: int, frequency: dict[str, int], templates: tuple[Template, ...] = TEMPLATES) -> list[tuple[str, int]]:
    """For each template its anchor: the word of its key phrase with the highest inverse document frequency, and its place
    in the template. Of equals the longest, then the first."""
    idf = {w: math.log((n + 1) / (c + 1)) for w, c in frequency.items()}
    out = []
    for t in templates:
        key = t.key.split()
        i = max(range(len(key)), key=lambda i: (idf.get(key[i], 0.0), len(key[i]), -i))
        out.append((key[i], t.key_at + i))
    return out


def _index(templates: list[Template], anchor: list[tuple[str, int]]) -> tuple[Column, Column]:
    """The postings of each rare word, and the templates as a table: both are constants of the plan."""
    postings: dict[str, list[Column]] = {}
    for n, (word, at) in enumerate(anchor):
        postings.setdefault(word, []).append(F.struct(F.lit(n).alias("t"), F.lit(at).alias("p")))
    rows = [F.struct(F.array(*map(F.lit, t.text.split())).alias("words"), F.array(*map(F.lit, t.key.split())).alias("key"), F.lit(t.key_at).alias("key_at")) for t in templates]
    return F.create_map(*(x for w, ps in postings.items() for x in (F.lit(w), F.array(*ps)))), F.array(*rows)


def _verified(w: Column, rare: list[str], postings: Column, table: Column) -> Column:
    """(t, start, share) of every place in the words ``w`` where the key phrase of template t stands."""
    # sequence() needs a word
    hits = F.coalesce(F.filter(F.sequence(F.lit(0), F.when(F.size(w) > 0, F.size(w) - 1)), lambda i: F.get(w, i).isin(rare)), F.array().cast("array<int>"))
    places = F.flatten(F.transform(hits, lambda i: F.transform(F.element_at(postings, F.get(w, i)), lambda q: F.struct(q["t"].alias("t"), (i - q["p"]).alias("start")))))

    def stands(c: Column) -> Column:
        own = F.get(table, c["t"])
        at = c["start"] + own["key_at"]
        return F.when(at >= 0, F.slice(w, F.greatest(at + 1, F.lit(1)), F.size(own["key"])) == own["key"]).otherwise(False)

    def share(c: Column) -> Column:
        own = F.get(table, c["t"])["words"]
        inside = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda k: F.coalesce(F.get(w, c["start"] + k) == F.get(own, k), F.lit(False)))
        return F.struct(c["t"].alias("t"), c["start"].alias("start"), (F.size(inside) / F.size(own).cast("double")).alias("share"))

    return F.transform(F.filter(places, stands), share)


def license_scan(df: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    n_base counts all places of BASE phrases, first_word and last_word are their smallest and largest start (null if
    none). labels adds those of the verified templates. score is 1 with a base label, else the largest share of a verified
    template in place, else 0. A null text is empty: no words, no labels, score 0. Repeated rows and null ids stay; other
    columns are not read; an empty table gives no rows.
    """
    own = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    every = [*(Template(label, phrase, phrase) for phrase, label in BASE), *templates]
    chosen = anchors(*document_frequencies(own, tuple(every)), tuple(every))
    postings, table = _index(every, chosen)
    rare = sorted({word for word, _ in chosen})

    def scan(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), _verified(w, rare, postings, table).alias("found"))

    names = F.array(*(F.lit(t.label) for t in every))
    is_base = lambda x: x["t"] < len(BASE)
    base = F.filter("s.found", is_base)
    places = F.transform(base, lambda x: x["start"])
    found = F.filter("s.found", lambda x: is_base(x) | (x["share"] >= COVERAGE))
    labels_of = lambda xs: F.array_join(F.sort_array(F.array_distinct(F.transform(xs, lambda x: F.get(names, x["t"])))), ",")
    return own.select("doc_id", bind(licence_words(F.col("text")), scan).alias("s")).select(
        "doc_id",
        F.col("s.n_words").alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        labels_of(base).alias("base_labels"),
        labels_of(found).alias("labels"),
        F.when(F.size(places) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform(found, lambda x: x["share"])), F.lit(0.0))).alias("score"),
    )


def oracle_sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """The same rows in DuckDB's SQL, every place of every text compared."""
    def here(phrase: str, at: str) -> str:
        return " AND ".join(f"coalesce(ws[{at} + {k}] = '{x}', false)" for k, x in enumerate(phrase.split()))

    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    base = ", ".join(f"list_filter(range(1, len(ws) + 1), lambda i: {here(p, 'i')}) AS b_{label}" for p, label in BASE)
    shares = []
    for n, t in enumerate(templates):
        own = "[" + ", ".join(f"'{x}'" for x in t.text.split()) + "]"
        inside = f"len(list_filter(range(0, {len(t.text.split())}), lambda k: i - {t.key_at} + k >= 1 AND coalesce(ws[i - {t.key_at} + k] = {own}[k + 1], false)))"
        shares.append(f"coalesce(list_max(list_filter(list_transform(list_filter(range(1, len(ws) + 1), lambda i: {here(t.key, 'i')}), lambda i: ({inside}) / {len(t.text.split())}.0::DOUBLE), lambda s: s >= {COVERAGE})), 0.0::DOUBLE) AS s{n}")
    labels = ", ".join([f"CASE WHEN len(b_{x}) > 0 THEN '{x}' END" for _, x in BASE] + [f"CASE WHEN s{n} > 0 THEN '{t.label}' END" for n, t in enumerate(templates)])
    only_base = ", ".join(f"CASE WHEN len(b_{x}) > 0 THEN '{x}' END" for _, x in BASE)
    joined = lambda x: f"array_to_string(list_sort(list_distinct(list_filter([{x}], lambda y: y IS NOT NULL))), ',')"
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
f AS (SELECT doc_id, len(ws)::BIGINT AS n_words, {base}, {', '.join(shares)} FROM w),
p AS (SELECT *, list_concat({', '.join(f'b_{x}' for _, x in BASE[:2])}) AS b2 FROM f),
q AS (SELECT *, list_concat(b2, b_{BASE[2][1]}) AS places FROM p)
SELECT doc_id, n_words, len(places)::BIGINT AS n_base, (list_min(places) - 1)::BIGINT AS first_word, (list_max(places) - 1)::BIGINT AS last_word,
       {joined(only_base)} AS base_labels, {joined(labels)} AS labels,
       CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE greatest({', '.join(f's{n}' for n in range(len(templates)))}) END AS score
FROM q
"""
