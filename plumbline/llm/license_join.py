"""License scan: phrase places, and an exact set-similarity join of text blocks
with license templates.

A block matches a template when it holds at least ``CONTAINMENT`` of the
template's distinct words, and all words that name the license: containment
alone cannot tell CC BY-NC from CC BY-SA.  Blocks are lines, the sentences of
paragraphs (a notice wrapped over lines is one) and, for templates of
``LONG_TEMPLATE`` words or more, paragraphs.  A match whose shared words are
part of those of another match of its block is no label of its own: "CC BY 4.0"
stands within "CC BY-SA 4.0".

Template words are ordered by their document frequency over the whole corpus,
rarest first:

* prefix filter: a match must hold one of the first |T| - need + 1 words;
* length filter: a match has at least ``need`` distinct words;
* positional filter: if the rarest word it shares stands at place r (from 0),
  at most |T| - r words can be shared, which must not be below ``need``.

Pairs that pass are verified on the whole word sets.  Each text is read and
taken apart once; its template words are written down, and the text itself only
if they can reach a template at all.  Templates are a fixed list of this module
(bounded), so the join is a broadcast one; texts are never shuffled.  All steps
are DataFrame operations.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.scratch import materialise

#: (phrase, label) of the contract of op4; fixed values.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Share of a template's distinct words that a block must hold.
CONTAINMENT = 0.8
#: Templates of at least so many distinct words are matched in paragraphs too.
LONG_TEMPLATE = 12
#: Label, name as notices write it, and the words that must all be there; fixed
#: values.
NAMES = (
    ("mit", "the mit license", "mit"),
    ("apache-2.0", "the apache license version 2.0", "apache"),
    ("gpl", "the gnu general public license", "gnu general public"),
    ("gpl-2.0", "the gnu general public license version 2", "gnu general public 2"),
    ("gpl-3.0", "the gnu general public license version 3", "gnu general public 3"),
    ("lgpl", "the gnu lesser general public license", "gnu lesser"),
    ("agpl-3.0", "the gnu affero general public license", "gnu affero"),
    ("bsd", "the bsd license", "bsd"),
    ("isc", "the isc license", "isc"),
    ("mpl-2.0", "the mozilla public license version 2.0", "mozilla"),
    ("epl-2.0", "the eclipse public license version 2.0", "eclipse"),
    ("cc0-1.0", "cc0 1.0 universal", "cc0"),
    ("cc-by-4.0", "cc by 4.0", "cc by 4"),
    ("cc-by-sa-4.0", "cc by-sa 4.0", "cc by sa 4"),
    ("cc-by-nc-4.0", "cc by-nc 4.0", "cc by nc 4"),
    ("cc-by-nd-4.0", "cc by-nd 4.0", "cc by nd 4"),
    ("cc-by-nc-sa-4.0", "cc by-nc-sa 4.0", "cc by nc sa 4"),
    ("cc-by-nc-nd-4.0", "cc by-nc-nd 4.0", "cc by nc nd 4"),
    ("cc-by-4.0", "a creative commons attribution 4.0 international license", "creative commons attribution 4"),
    ("cc-by-sa-4.0", "a creative commons attribution-sharealike 4.0 international license", "creative commons attribution sharealike 4"),
    ("cc-by-nc-4.0", "a creative commons attribution-noncommercial 4.0 international license", "creative commons attribution noncommercial 4"),
    ("cc-by-nd-4.0", "a creative commons attribution-noderivatives 4.0 international license", "creative commons attribution noderivatives 4"),
    ("cc-by-nc-sa-4.0", "a creative commons attribution-noncommercial-sharealike 4.0 international license", "creative commons attribution noncommercial sharealike 4"),
    ("cc-by-nc-nd-4.0", "a creative commons attribution-noncommercial-noderivatives 4.0 international license", "creative commons attribution noncommercial noderivatives 4"),
)
#: How a notice begins; fixed values.
LEADS = ("licensed under", "released under")
#: Label, wording and the words that must all be there of license texts and
#: standard notices; fixed values.
TEXTS = (
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "permission granted sublicense",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "permission fee granted",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "redistribution binary",
    ),
    (
        "zlib",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "permission anyone alter redistribute",
    ),
    (
        "bsl-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
        "permission reproduce execute transmit",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "unencumbered public domain",
    ),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "apache compliance",
    ),
    (
        "apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "unless writing governing permissions limitations",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "gnu general foundation",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "gnu lesser foundation",
    ),
    (
        "agpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "gnu affero foundation",
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "mozilla subject",
    ),
)
#: (label, wording, words that must all be there).
Template = tuple[str, str, str]
TEMPLATES: tuple[Template, ...] = (*((label, f"{lead} {name}", must) for lead in LEADS for label, name, must in NAMES), *TEXTS)

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: ``WORD``, its characters listed one by one: the JVM looks these up in a bit
#: table, ranges one after another, which takes 16 times as long.
LISTED_WORD = "[^" + "".join(f"\\x{c:02X}" for c in range(128) if not (chr(c).isdigit() or chr(c).islower())) + "]+"
#: Ends of paragraphs and, within them, of sentences.
PARAGRAPH, SENTENCE = r"\n[ \t\r]*\n+", r"[.!?][ \t\r\n]+"
_NO_WORDS = "array<string>"


def low_of(text: Column) -> Column:
    """The text with A-Z lower-cased, for words of ASCII letters.  Other upper-case
    letters are lower-cased too, which moves no word's place and makes no word
    ASCII but for the Kelvin sign; that one is replaced first.  Null is empty."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00ff")))


def words_of(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit(LISTED_WORD), F.lit(0))


def _strings(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast(_NO_WORDS)


def template_words(text: str) -> list[str]:
    """Distinct words of a template, in order."""
    return list(dict.fromkeys("".join(c if c.isalnum() else " " for c in text.lower()).split()))


def needed(words: list[str], containment: float) -> int:
    return max(1, math.ceil(containment * len(words) - 1e-9))


def _stands_at(words: list[str]) -> Callable[[Column], Column]:
    return lambda i: reduce(and_, [F.get("words", i + j) == w for j, w in enumerate(words)])


def taken_apart(docs: DataFrame, phrases: tuple[tuple[str, str], ...], templates: tuple[Template, ...], containment: float) -> DataFrame:
    """``docs`` (doc_id, text_key, text) as ``(doc_id, text_key, n_words, places,
    base, held, low)``, in one pass over the texts: starts of all phrases and
    their labels, the words of phrases and templates that a text holds, and the
    lower-cased text if those words reach a template."""
    split = [(p.split(" "), label) for p, label in phrases]
    vocabulary = sorted({w for p, _ in split for w in p} | {w for _, text, _ in templates for w in template_words(text)})
    docs = docs.withColumn("low", low_of(F.col("text"))).withColumn("words", words_of(F.col("low"))).withColumn("held", F.array_intersect("words", _strings(vocabulary)))
    none = F.array().cast("array<int>")
    starts = {}
    for k, (words, _) in enumerate(split):
        room = F.size("words") - len(words)
        there = reduce(and_, [F.array_contains("held", w) for w in words]) & (room >= 0)
        starts[f"p{k}"] = F.when(there, F.filter(F.sequence(F.lit(0), F.greatest(room, F.lit(0))), _stands_at(words))).otherwise(none)
    naming = [must.split()[0] for _, _, must in templates]
    sets = F.array(*[F.struct(_strings(must.split()).alias("must"), _strings(template_words(text)).alias("words"), F.lit(needed(template_words(text), containment)).alias("need")) for _, text, must in templates])
    reach = F.exists(sets, lambda t: (F.size(F.array_except(t["must"], F.col("held"))) == 0) & (F.size(F.array_intersect(t["words"], F.col("held"))) >= t["need"]))
    near = F.when(F.arrays_overlap("held", _strings(sorted(set(naming)))), reach).otherwise(False) if templates else F.lit(False)
    docs = docs.select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"), "held", *[x.alias(name) for name, x in starts.items()], F.when(near, F.col("low")).alias("low"))
    labels = F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, label) for k, (_, label) in enumerate(split)]))
    return docs.select("doc_id", "text_key", "n_words", F.concat(*starts).alias("places"), labels.alias("base"), "held", "low")


def document_frequencies(apart: DataFrame) -> dict[str, int]:
    """In how many documents of the corpus each word of the phrases and
    templates stands; at most as many rows as they have words."""
    return {r["w"]: r["n"] for r in apart.select(F.explode("held").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}


def template_index(templates: tuple[Template, ...], frequency: dict[str, int], containment: float) -> list[tuple[int, str, list[str], list[str], int]]:
    """(id, label, words from the rarest on, naming words, need)."""
    rarest = lambda w: (frequency.get(w, 0), w)
    return [(k, label, sorted(template_words(text), key=rarest), must.split(), needed(template_words(text), containment)) for k, (label, text, must) in enumerate(templates)]


def blocks_of(low: Column) -> Column:
    """All blocks of a text as (whole paragraph or not, piece)."""
    paragraphs = F.split(low, PARAGRAPH)
    sentences = F.flatten(F.transform(paragraphs, lambda p: F.split(p, SENTENCE)))
    named = lambda pieces, whole: F.transform(pieces, lambda x: F.struct(F.lit(whole).alias("paragraph"), x.alias("piece")))
    return F.concat(named(F.split(low, "\n"), False), named(sentences, False), named(paragraphs, True))


def matching_blocks(apart: DataFrame, templates: tuple[Template, ...], containment: float) -> DataFrame:
    """``(doc_id, text_key, block, label, containment)`` of every block and
    template that match, blocks numbered along ``blocks_of``, but for matches
    that are part of another match of their block."""
    index = template_index(templates, document_frequencies(apart), containment)
    prefix = sorted({w for _, _, words, _, need in index for w in words[: len(words) - need + 1]})
    pieces = apart.filter("low is not null").select("doc_id", "text_key", F.posexplode(blocks_of(F.col("low"))).alias("block", "b"))
    pieces = pieces.select("doc_id", "text_key", "block", "b.paragraph", F.array_distinct(words_of(F.col("b.piece"))).alias("held"))
    keys = pieces.withColumn("key", F.explode(F.array_intersect("held", _strings(prefix))))

    rows = [(w, label, words, must, r, need, len(words)) for _, label, words, must, need in index for r, w in enumerate(words[: len(words) - need + 1])]
    small = apart.sparkSession.createDataFrame(rows, "key string, label string, words array<string>, must array<string>, place int, need int, size int")
    paired = keys.join(F.broadcast(small), "key").filter(
        (F.size("held") >= F.col("need"))  # length
        & (F.col("size") - F.col("place") >= F.col("need"))  # position
        & (~F.col("paragraph") | (F.col("size") >= LONG_TEMPLATE))
    )
    # One row for a pair however many prefix words it shares: the rarest's.
    paired = paired.withColumn("shared", F.array_intersect("words", "held"))
    verified = paired.filter((F.col("key") == F.get("shared", F.lit(0))) & (F.size("shared") >= F.col("need")) & (F.size(F.array_except("must", "held")) == 0))
    found = verified.groupBy("doc_id", "text_key", "block").agg(F.collect_list(F.struct("label", "shared", (F.size("shared") / F.col("size")).alias("containment"))).alias("m"))  # at most a row for each template
    within = lambda a, b: (F.size(a["shared"]) < F.size(b["shared"])) & (F.size(F.array_except(a["shared"], b["shared"])) == 0)
    best = F.filter("m", lambda a: ~F.exists("m", lambda b: within(a, b)))
    return found.select("doc_id", "text_key", "block", F.explode(best).alias("m")).select("doc_id", "text_key", "block", "m.label", "m.containment")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: tuple[tuple[str, str], ...] = PHRASES, templates: tuple[Template, ...] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score)``, one row per row of ``docs``; ``score`` is the best containment of
    a match that gives a label, 0 without one.

    A null or empty text has no words and no labels.  Repeated rows and null
    ids are kept; rows of one id but different texts are told apart by a hash
    of the text.  An empty table gives an empty result; columns of other names
    are not looked at.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    given = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    apart = materialise(taken_apart(given, phrases, templates, containment), "license-words")
    found = matching_blocks(apart, templates, containment).groupBy("doc_id", "text_key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("score"))
    found = materialise(found, "license-blocks").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "more", "score")
    # Only rows that may have matches are shuffled, the others pass by.
    columns = ("doc_id", "text_key", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"), "base")
    near = apart.filter("low is not null").select(*columns).join(found, (F.col("text_key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    far = apart.filter("low is null").select(*columns).withColumns({"more": F.lit(None).cast(_NO_WORDS), "score": F.lit(None).cast("double")})
    joined = near.drop("__id", "__key").unionByName(far)
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        listed(F.col("base")).alias("base_labels"),
        listed(F.concat("base", F.coalesce("more", F.array().cast(_NO_WORDS)))).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def _sql() -> str:
    """The definition as it stands above, without any filter: every block of
    every text against every template."""
    sets = ", ".join(f"({k}, '{label}', {template_words(t)!r}, {must.split()!r})" for k, (label, t, must) in enumerate(TEMPLATES))
    parts = []
    for p, _ in PHRASES:
        ws = p.split(" ")
        same = " AND ".join(f"w[i + {j + 1}] = '{x}'" for j, x in enumerate(ws))
        parts.append(f"list_filter(range(0, greatest(0, len(w) - {len(ws) - 1})), lambda i: {same})")
    labels = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(PHRASES))
    lists = ", ".join(f"{x} AS p{k}" for k, x in enumerate(parts))
    every = " || ".join(f"p{k}" for k in range(len(PHRASES)))
    return f"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT doc_id, regexp_extract_all(t, '{WORD}') AS w FROM low),
places AS (SELECT doc_id, len(w) AS n_words, {lists} FROM words),
base AS (SELECT doc_id, n_words, {every} AS pos, list_filter([{labels}], lambda x: x IS NOT NULL) AS base FROM places),
templates(template, label, tw, must) AS (VALUES {sets}),
paragraphs AS (SELECT doc_id, unnest(string_split_regex(t, '\\n[ \\t\\r]*\\n+')) AS piece FROM low),
blocks AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS piece, false AS paragraph FROM low
  UNION SELECT doc_id, unnest(string_split_regex(piece, '[.!?][ \\t\\r\\n]+')), false FROM paragraphs
  UNION SELECT doc_id, piece, true FROM paragraphs),
held AS (SELECT doc_id, row_number() OVER () AS block, paragraph, list_distinct(regexp_extract_all(piece, '{WORD}')) AS h FROM blocks),
matches AS (
  SELECT doc_id, block, template, label, list_intersect(tw, h) AS shared, len(list_intersect(tw, h)) / len(tw) AS share
  FROM held CROSS JOIN templates
  WHERE list_has_all(h, must) AND len(list_intersect(tw, h)) >= ceil({CONTAINMENT}::DOUBLE * len(tw) - 1e-9) AND (NOT paragraph OR len(tw) >= {LONG_TEMPLATE})),
found AS (
  SELECT doc_id, list(DISTINCT label) AS more, max(share) AS score FROM matches a
  WHERE NOT EXISTS (SELECT 1 FROM matches b WHERE a.block = b.block AND len(a.shared) < len(b.shared) AND list_has_all(b.shared, a.shared))
  GROUP BY doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, len(pos)::BIGINT AS n_base, list_min(pos)::BIGINT AS first_word, list_max(pos)::BIGINT AS last_word,
       array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(base || coalesce(more, []))), ',') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM base LEFT JOIN found USING (doc_id)
"""


#: DuckDB SQL of op4 over the view ``documents``.
SQL = _sql()
