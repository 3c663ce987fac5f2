"""Licence notices in texts, by the Dice coefficient over word bigrams.

Texts and templates are normalised alike: A-Z in lower case, every run of other characters than letters, digits and
dots as one space, dots at the ends of words dropped.  A *unit* is a line of a document, or the whole document.  With
the threshold t, only templates of at least t / (2 - t) and at most (2 - t) / t times a unit's number of bigrams can
match it; a unit that no template's bounds admit, or that shares no bigram with any, is not compared.

All of it is DataFrame functions, and nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices of common licences, by their SPDX identifiers.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)

_OTHER = r"[^a-z0-9.\n]+|\.+(?=[^a-z0-9.]|$)"


def normal(text: str) -> str:
    """A text as it is compared."""
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return " ".join(re.sub(r"[^a-z0-9.]+|\.+(?=[^a-z0-9.]|$)", " ", lower).split(" ")).strip()


def template_bigrams(templates) -> list[tuple[str, list[str]]]:
    """(name, distinct bigrams) of each template."""
    out = []
    for name, text in templates:
        w = [x for x in normal(text).split(" ") if x]
        out.append((name, sorted({f"{a} {b}" for a, b in zip(w, w[1:])})))
    return out


def find_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a unit that matches: doc_id, line (from 0; -1: the whole document), license, dice.

    A notice wrapped over several lines of a longer document, or within a longer line, is no unit and is not found.
    The best template is named, of equal ones the first by name.  A document of one line gives two units.  A null or
    empty text, or a unit of fewer than two words, matches nothing.  Rows that repeat are scanned each, a null id is
    carried, an empty table gives an empty result; other columns are not used.
    """
    known = [(name, grams) for name, grams in template_bigrams(templates) if grams]
    sizes = sorted({len(g) for _, g in known})
    share = threshold / (2 - threshold)
    least, most = min(sizes) * share, max(sizes) / share

    def longs(grams: list[str]) -> Column:
        return F.array(*(F.xxhash64(F.lit(g)) for g in grams))

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    clean = F.regexp_replace(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), _OTHER, " ")
    lines = d.select("doc_id", F.posexplode(F.concat(F.array(F.translate(clean, "\n", " ")), F.split(clean, "\n"))).alias("line", "unit"))
    every = longs(sorted({g for _, grams_of in known for g in grams_of}))

    def bigrams(words: Column) -> Column:
        last = F.size(words) - 1
        return F.when(last >= max(1, least), F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.concat_ws(" ", F.try_element_at(words, i), F.try_element_at(words, i + 1))))))

    def best(grams: Column) -> Column:
        n = F.size(grams)
        scores = []
        for rank, (name, g) in enumerate(sorted(known)):
            fits = (n >= len(g) * share) & (n <= len(g) / share)
            dice = F.when(fits, 2.0 * F.size(F.array_intersect(grams, longs(g))) / (n + len(g))).otherwise(0.0)
            scores.append(F.struct(dice.alias("dice"), F.lit(-rank).alias("rank"), F.lit(name).alias("license")))
        return F.when((n >= least) & (n <= most) & F.arrays_overlap(grams, every), F.array_max(F.array(*scores)))

    # a one-element array binds a value once; a generator keeps the filter where it is
    words = F.split(F.trim(F.regexp_replace("unit", " {2,}", " ")), " ")
    found = F.transform(F.transform(F.array(words), bigrams), best)
    found = F.filter(found, lambda x: x["dice"] >= threshold)
    return lines.select("doc_id", (F.col("line") - 1).alias("line"), F.explode(found).alias("best")).select("doc_id", "line", F.col("best.license").alias("license"), F.col("best.dice").alias("dice"))


def oracle(templates=TEMPLATES, threshold: float = 0.8) -> str:
    """The DuckDB SQL of ``find_licenses`` over ``documents``."""
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    rows = ", ".join(f"({rank}, {quoted(name)}, [{', '.join(map(quoted, g))}])" for rank, (name, g) in enumerate(sorted(template_bigrams(templates))))
    return rf"""
        with t(rank, license, grams) as (values {rows}),
        c as (select doc_id, regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9.\n]+', ' ', 'g') as text from documents),
        e as (select doc_id, regexp_replace(text, '\.+([^a-z0-9.]|$)', ' \1', 'g') as text from c),
        u as (select doc_id, -1 as line, replace(text, chr(10), ' ') as unit from e
            union all select doc_id, unnest(range(len(string_split(text, chr(10))))) as line, unnest(string_split(text, chr(10))) as unit from e),
        w as (select doc_id, line, list_filter(string_split(unit, ' '), lambda x: x <> '') as words from u),
        g as (select doc_id, line, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) as grams from w where len(words) >= 2),
        s as (select doc_id, line, license, rank, 2.0 * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) as dice
            from g, t where list_has_any(g.grams, t.grams)),
        b as (select *, row_number() over (partition by doc_id, line order by dice desc, rank) as n from s where dice >= {threshold})
        select doc_id, cast(line as integer) as line, license, cast(dice as double) as dice from b where n = 1
    """
