"""Licence scans with a positional rare-token index, in SQL functions alone.

Each template is a run of words with one mandatory key phrase: short notices, and the wording of
whole licences. One pass splits the texts and stores, for each document, the places of all words
that templates have (hits). The documents' frequencies of these words follow from the hits; the
POSTINGS words of a key phrase with the highest IDF are indexed, each with its template and its
position there. A document's indexed words are looked up; a posting proposes the start that its
relative position implies, and the postings of a template are intersected: only starts that all
of them propose stand. There the whole key phrase must be in place, and a share of LEAST of all
the template's words. As the key phrase must match in full, the intersection loses nothing, and
words that are common in the corpus are never looked up.

Defined cases: a null or empty text has no words and no labels (empty strings, score 0, null
positions); places may overlap and all count; repeated rows are judged one by one; a text of
any length is scanned once, left to right; columns named like results are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stored

#: All ASCII but digits and lower-case letters. Texts are lower-cased before.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP_CHARS = "".join(chr(c) for c in (*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)))
LEAST = 0.8
#: Words of a key phrase that are indexed.
POSTINGS = 4


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_at(self) -> int:
        k = self.key.split()
        return next(i for i in range(len(self.words)) if self.words[i : i + len(k)] == k)


# The base phrases and public licence wording, without punctuation.
TEMPLATES = (
    Template("mit", "under the mit license", "under the mit license", True),
    Template("apache-2", "apache license version 2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", "cc by nc", True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software"
        " without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit"
        " persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all"
        " copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the"
        " warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages"
        " or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code"
        " must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice"
        " this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "redistributions of source code must retain the above copyright notice",
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this"
        " permission notice appear in all copies",
        "for any purpose with or without fee is hereby granted",
    ),
    Template(
        "zlib",
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the"
        " following restrictions",
        "including commercial applications and to alter it and redistribute it freely",
    ),
    Template(
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "you may not use this file except in compliance with the license",
    ),
    Template("gpl-2", "gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl-3", "gnu general public license version 3", "gnu general public license version 3"),
    Template(
        "gpl-2",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license",
        "as published by the free software foundation either version 2 of the license",
    ),
    Template(
        "gpl-3",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license",
        "as published by the free software foundation either version 3 of the license",
    ),
    Template("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    Template("mpl-2", "mozilla public license version 2", "mozilla public license version 2"),
    Template(
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
        "subject to the terms of the mozilla public license",
    ),
    Template("cc-by-sa", "cc by sa", "cc by sa"),
    Template("cc-by-nc", "creative commons attribution noncommercial", "creative commons attribution noncommercial"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
    Template("all-rights-reserved", "all rights reserved", "all rights reserved"),
)


def words_of(text: str = "text") -> F.Column:
    """The words of a text column as an array, A-Z in lower case; other letters stay as they are."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    bare = F.btrim(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), upper, upper.lower()), F.lit(_GAP_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def hits_of(docs: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES, keep: list[str] | None = None) -> DataFrame:
    """The documents' columns (or those of keep), n_words, and hits: each word that a template has,
    with its place, in order. Stored, so that texts are split once."""
    known = ", ".join(sorted({_quote(w) for t in templates for w in t.words}))
    found = F.expr(f"filter(transform(__words, (w, i) -> named_struct('word', w, 'at', i)), h -> h.word IN ({known}))")
    names = [c for c in (docs.columns if keep is None else keep) if c not in _RESULTS]
    return stored(docs.withColumn("__words", words_of(text)).select(*names, F.size("__words").cast("long").alias("n_words"), found.alias("__hits")), "hits")


def document_frequencies(hits: DataFrame) -> tuple[int, dict[str, int]]:
    """The number of documents, and of those that have each of the templates' words (a bounded set)."""
    words = F.explode(F.array_union(F.array(F.lit("")), F.transform("__hits", lambda h: h["word"])))  # "": every document
    counts = {r["word"]: r["n"] for r in hits.select(words.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return counts.pop("", 0), counts


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_RESULTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def postings_of(templates: tuple[Template, ...], total: int, df: dict[str, int], most: int = POSTINGS) -> list[tuple[str, int, int]]:
    """(word, template, position) of the words of each key phrase with the highest IDF."""
    idf = lambda w: math.log((total + 1) / (df.get(w, 0) + 1))
    out = []
    for i, t in enumerate(templates):
        key = t.key.split()
        picked = sorted(range(len(key)), key=lambda j: (-idf(key[j]), j))[:most]
        out += [(key[j], i, t.key_at + j) for j in sorted(picked)]
    return out


def scan(docs: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES, least: float = LEAST, keep: list[str] | None = None) -> DataFrame:
    """The documents' columns (or those of keep) with n_words, n_base, first_word, last_word, base_labels, labels and score."""
    hits = hits_of(docs, text, templates, keep)
    postings = postings_of(templates, *document_frequencies(hits))
    rare = ", ".join(sorted({_quote(w) for w, _, _ in postings}))
    index = "array(" + ", ".join(f"named_struct('word', {_quote(w)}, 't', {i}, 'at', {at})" for w, i, at in postings) + ")"
    need = "array(" + ", ".join(str(sum(i == k for _, i, _ in postings)) for k in range(len(templates))) + ")"
    table = [f"named_struct('label', {_quote(t.label)}, 'base', {str(t.base).lower()}, 'words', array({', '.join(map(_quote, t.words))}), 'from', {t.key_at}, 'to', {t.key_at + len(t.key.split())})" for t in templates]
    # A column in a lambda would be made anew for each element; transform(array(x), x -> ...) binds it once.
    bound = lambda value, name, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    # Proposals: a posting's start, and the hit that the template's first word would be if each of its words were one.
    proposed = f"""sort_array(flatten(transform(filter(sequence(0, size(hs) - 1), k -> get(hs, k).word IN ({rare})),
        k -> transform(filter({index}, p -> p.word = get(hs, k).word), p -> named_struct('t', p.t, 'at', get(hs, k).at - p.at, 'k', k - p.at)))))"""
    # Intersection: as many equal proposals of a start as the template has postings. The first has the least k.
    agreed = f"""filter(ps, (p, i) -> (i = 0 OR get(ps, i - 1).t <> p.t OR get(ps, i - 1).at <> p.at)
        AND get(ps, i + get({need}, p.t) - 1).t = p.t AND get(ps, i + get({need}, p.t) - 1).at = p.at)"""
    # A place's words are among as many hits as the template has words, from the hit k on: at most one hit each.
    same = bound("get(hs, k)", "h", "h.at - s.at >= 0 AND h.at - s.at < size(tp.words) AND get(tp.words, h.at - s.at) = h.word")
    there = f"transform(filter(sequence(greatest(s.k, 0), least(s.k + size(tp.words), size(hs)) - 1), k -> coalesce({same}, false)), k -> get(hs, k).at - s.at)"
    judged = bound(f"get(array({', '.join(table)}), s.t)", "tp", bound(there, "js", "named_struct('label', tp.label, 'base', tp.base, 'at', s.at, 'whole', size(filter(js, j -> j >= tp.from AND j < tp.to)) = tp.to - tp.from, 'share', size(js) / size(tp.words))"))
    places = f"CASE WHEN exists(__hits, h -> h.word IN ({rare})) THEN filter({bound('__hits', 'hs', bound(proposed, 'ps', f'transform({agreed}, s -> {judged})'))}, m -> m.whole AND m.share >= {least}) END"
    told = lambda keep_: f"coalesce(array_join(array_sort(array_distinct(transform(filter(hs, m -> {keep_}), m -> m.label))), ','), '')"
    base = "transform(filter(hs, m -> m.base), m -> m.at)"
    out = F.expr(f"""element_at(transform(array(__places), hs -> named_struct('n_base', greatest(coalesce(CAST(size({base}) AS BIGINT), 0L), 0L),
        'first_word', CAST(array_min({base}) AS BIGINT), 'last_word', CAST(array_max({base}) AS BIGINT), 'base_labels', {told("m.base")}, 'labels', {told("true")},
        'score', coalesce(array_max(transform(hs, m -> CAST(m.share AS DOUBLE))), 0D))), 1)""")
    rows = hits.withColumn("__places", F.expr(places)).withColumn("__out", out)
    return rows.select(*[c for c in hits.columns if c not in ("n_words", "__hits")], "n_words", *[F.col(f"__out.{n}").alias(n) for n in _RESULTS[1:]])


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"), keep=["doc_id"])


_SEP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PHRASES = ", ".join(f"({i}, {_quote(t.label)}, {str(t.base).lower()}, [{', '.join(map(_quote, t.words))}], {t.key_at}, {len(t.key.split())})" for i, t in enumerate(TEMPLATES))
OP10_SQL = rf"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
w AS (SELECT doc_id, list_filter(string_split_regex(x, '{_SEP}'), lambda v: v <> '') AS ws FROM d),
t(k, label, base, words, key_at, key_n) AS (VALUES {_PHRASES}),
s AS (SELECT doc_id, ws, unnest(generate_series(0, len(ws) - 1)) AS p FROM w WHERE len(ws) > 0),
c AS (SELECT doc_id, p - key_at AS pos, label, base, list_sum(list_transform(generate_series(1, len(words)), lambda j: CASE WHEN p - key_at + j >= 1 AND ws[greatest(p - key_at + j, 1)] = words[j] THEN 1 ELSE 0 END)) / len(words) AS share
      FROM s JOIN t ON ws[p + 1] = words[key_at + 1] AND ws[p + 1 : p + key_n] = words[key_at + 1 : key_at + key_n]),
h AS (SELECT * FROM c WHERE share >= {LEAST}),
g AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(pos) FILTER (base) AS first_word, max(pos) FILTER (base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM h GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM w LEFT JOIN g ON g.doc_id = w.doc_id
"""
