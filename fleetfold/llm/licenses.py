"""Licence scan with a positional index of rare licence words.

Templates are passages of licences. Each is indexed by its words of highest inverse document frequency
over the templates, at least two of them from its key phrase, with their positions. A text is searched
for indexed words only. Each hit proposes, by relative position, the place where the template would
start; a place that two postings of one template agree on is a candidate. There the template is laid
over the text word by word: its label is given where the whole key phrase stands and enough of the
template is in place. The two words from the phrase make this lossless: no place that deserves the
label can miss being a candidate. All of it happens within the row: nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfold.llm.common import alnum_words, whole_text


class Template(NamedTuple):
    """``base`` templates count every place of their phrase, whatever surrounds it."""

    label: str
    phrase: str
    text: str
    base: bool = False


# fixed values: label, mandatory phrase and text of passages of public licences; the base phrases are the contract's
TEMPLATES = (
    Template("cc-by", "cc by", "Licensed under CC BY 4.0.", True),
    Template("gpl", "general public license", "under the terms of the GNU General Public License", True),
    Template("reserved", "all rights reserved", "All rights reserved.", True),
    Template("cc-by-nc", "cc by nc", "Licensed under CC BY-NC 4.0."),
    Template("cc-by-sa", "cc by sa", "Licensed under CC BY-SA 4.0."),
    Template("creative-commons", "creative commons attribution 4 0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    Template("cc-by-sa", "attribution sharealike 4 0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    Template("cc-by-nc", "attribution noncommercial 4 0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    Template(
        "cc0",
        "waived all copyright and related or neighboring rights",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    Template("gpl-3.0", "general public license version 3", "This work is licensed under the GNU General Public License, version 3."),
    Template("gpl-2.0", "general public license version 2", "This work is licensed under the GNU General Public License, version 2."),
    Template(
        "gpl-3.0",
        "either version 3 of the license",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    Template(
        "gpl-2.0",
        "either version 2 of the license",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    Template(
        "lgpl",
        "lesser general public license",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    Template(
        "agpl",
        "affero general public license",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    Template("apache-2.0", "apache license version 2 0", "Licensed under the Apache License, Version 2.0."),
    Template(
        "apache-2.0",
        "apache license version 2 0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    Template(
        "apache-2.0",
        "governing permissions and limitations under the license",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ),
    Template("mit", "mit license", "Released under the MIT License."),
    Template(
        "mit",
        "permission is hereby granted free of charge",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:",
    ),
    Template(
        "mit",
        "all copies or substantial portions of the software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    Template(
        "isc",
        "with or without fee is hereby granted",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    Template(
        "bsd-3-clause",
        "used to endorse or promote products derived from this software",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission.",
    ),
    Template(
        "mpl-2.0",
        "mozilla public license v 2 0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at",
    ),
    Template("unlicense", "unencumbered software released into the public domain", "This is free and unencumbered software released into the public domain."),
    Template("public-domain", "dedicated to the public domain", "This work is dedicated to the public domain."),
)

RARE_WORDS = 5  # postings a template has at least, if it has as many words
AGREEING = 2  # postings that must propose the same start
COVERAGE = 0.75  # share of a template's words in place for its label


class Indexed(NamedTuple):
    label: str
    base: bool
    words: tuple[str, ...]
    phrase_at: int
    phrase_words: int
    rare: tuple[tuple[str, int], ...]


def template_words(text: str) -> tuple[str, ...]:
    return tuple(re.findall("[0-9a-z]+", text.lower()))


def index_templates(templates=TEMPLATES, rare_words: int = RARE_WORDS) -> list[Indexed]:
    """The templates with their postings: rarest words over all templates first, longer ones among equals.

    Two words of the phrase are always among them; a phrase of one word, or one missing from its text, is refused.
    """
    every = [template_words(t.text) for t in templates]
    idf = {w: math.log(len(every) / sum(w in e for e in every)) for e in every for w in e}
    found = []
    for template, words in zip(templates, every):
        phrase = template_words(template.phrase)
        starts = [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
        if len(phrase) < AGREEING or not starts:
            raise ValueError(f"the phrase {template.phrase!r} must have {AGREEING} words and stand in its template")
        at = starts[0]
        by_rarity = sorted(range(len(words)), key=lambda i: (-idf[words[i]], -len(words[i]), i))
        chosen = [i for i in by_rarity if at <= i < at + len(phrase)][:AGREEING]
        chosen += [i for i in by_rarity if i not in chosen][: max(0, rare_words - AGREEING)]
        if template.base:
            chosen = chosen[:AGREEING]
        found.append(Indexed(template.label, template.base, words, at, len(phrase), tuple((words[i], i) for i in sorted(chosen))))
    return found


def _array(values) -> Column:
    return F.array(*map(F.lit, values))


def _proposals(words: Column, index: list[Indexed]) -> Column:
    """Sorted (template, start) pairs, one for each posting whose word stands where the start wants it."""
    postings: dict[str, list[Column]] = {}
    for number, entry in enumerate(index):
        for word, at in entry.rare:
            postings.setdefault(word, []).append(F.struct(F.lit(number).alias("t"), F.lit(at).alias("at")))
    lookup = F.create_map(*(c for word, found in postings.items() for c in (F.lit(word), F.array(*found))))
    placed = F.transform(words, lambda w, i: F.when(w.isin(list(postings)), F.struct(w.alias("word"), i.alias("at"))))
    hits = F.filter(placed, lambda h: h.isNotNull())
    proposed = F.transform(
        hits,
        lambda h: F.transform(F.try_element_at(lookup, h["word"]), lambda p: F.struct(p["t"].alias("t"), (h["at"] - p["at"]).alias("start"))),
    )
    return F.when(F.arrays_overlap(words, _array(postings)), F.sort_array(F.flatten(proposed)))


def _laid_over(words: Column, candidates: Column, index: list[Indexed]) -> Column:
    """Each candidate with the place of its phrase, whether the phrase stands there, and the share of words in place."""
    entries = F.array(
        *(
            F.struct(
                F.lit(e.label).alias("label"),
                F.lit(e.base).alias("base"),
                _array(e.words).alias("words"),
                F.lit(e.phrase_at).alias("phrase_at"),
                F.lit(e.phrase_words).alias("phrase_words"),
            )
            for e in index
        )
    )

    def in_place(c, template):
        return F.filter(F.transform(template["words"], lambda w, i: F.when(w == F.get(words, c["start"] + i), i)), lambda i: i.isNotNull())

    def laid(c):
        template = F.get(entries, c["t"])
        matched = in_place(c, template)
        of_phrase = F.filter(matched, lambda i: (i >= template["phrase_at"]) & (i < template["phrase_at"] + template["phrase_words"]))
        return F.struct(
            template["label"].alias("label"),
            template["base"].alias("base"),
            (c["start"] + template["phrase_at"]).alias("start"),
            (F.size(of_phrase) == template["phrase_words"]).alias("phrase"),
            (F.size(matched) / F.size(template["words"])).alias("share"),
        )

    return F.transform(candidates, laid)


def scan_licenses(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), templates=TEMPLATES) -> DataFrame:
    """``keep`` columns, n_words and ``places``: every candidate (label, base, start of its phrase, phrase, share).

    Row by row: null keys and repeated rows are rows like others; a null or empty text has no places, an empty
    table gives no rows, and columns that are not kept are not read. A template may begin before the text or end
    behind it; words beyond the ends are not in place.
    """
    index = index_templates(templates)
    split = docs.select(*(F.col(f"`{c}`") for c in keep), alnum_words(whole_text(text)).alias("_words"))
    sought = split.select("*", _proposals(F.col("_words"), index).alias("_proposals"))
    proposals = F.col("_proposals")

    def agreed(pair, i):
        first = ~F.coalesce(F.get(proposals, i - 1) == pair, F.lit(False))
        return first & F.coalesce(F.get(proposals, i + (AGREEING - 1)) == pair, F.lit(False))

    found = sought.select("*", F.filter(proposals, agreed).alias("_candidates"))
    places = F.coalesce(_laid_over(F.col("_words"), F.col("_candidates"), index), F.array())
    return found.select(*(F.col(f"`{c}`") for c in keep), F.size("_words").cast("long").alias("n_words"), places.alias("places"))


def license_report(docs: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """One row per document: counts, extreme places and labels of the base phrases, labels of all templates, score.

    The score is the greatest share of a template in place at any candidate, with or without its phrase: a text with
    a score and no label holds a changed licence.
    """
    places = F.col("places")
    found = scan_licenses(docs).select(
        "*",
        F.filter(places, lambda p: p["base"] & p["phrase"]).alias("base_places"),
        F.filter(places, lambda p: p["phrase"] & (p["base"] | (p["share"] >= coverage))).alias("labelled"),
    )
    starts = F.transform("base_places", lambda p: p["start"])
    labels = lambda of: F.array_join(F.sort_array(F.array_distinct(F.transform(of, lambda p: p["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base_places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        labels("base_places").alias("base_labels"),
        labels("labelled").alias("labels"),
        F.coalesce(F.array_max(F.transform(places, lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )
