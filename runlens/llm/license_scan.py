"""License scans [native]: text blocks compared with licence templates by Dice coefficient over word bigrams.

A document's blocks are its lines and its paragraphs of several lines, which blank lines set off. Beside them
every run of consecutive words is compared that has at most as many bigrams as the size bounds allow, whatever
lines it stands in: notices wrapped over lines, between other lines or inside a longer line. Blocks, runs and
templates are normalised alike: lower-case A-Z, every run of other characters than a-z and 0-9 one space.
Dice = 2 * shared bigrams / (bigrams of block + bigrams of template), over sets of bigrams. As at most the
smaller set can be shared, Dice >= t needs t / (2 - t) <= size of block / size of template <= (2 - t) / t;
templates outside these bounds are pruned by their size before any bigram is compared. By the same bounds a run
holds at least t / (2 - t) of a template's bigrams, and the best run begins and ends with one of them: only
stretches with so many of them are measured.

``license`` and ``score`` are those of the best block or run. ``n_matches`` counts the blocks that match and,
from left to right, the best run of a start and template if it shares no word with such a block or with the run
counted before. The only paragraph of a text is compared too, and counts where nothing else does.

Everything happens within a row: no shuffle, no Python; the templates are literals of fixed number.

Defined cases: null, empty or too short text matches nothing (``license`` null, ``score`` 0.0, ``n_matches``
0); of equal scores the earlier template wins; repeated rows give repeated results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import ascii_lower, text_or_empty

THRESHOLD = 0.8

#: Fixed values: (SPDX id, wording) of usual licence notices.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                   "except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the "
                "GNU General Public License as published by the Free Software Foundation, either version 3 of the "
                "License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are "
                     "permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
            "is hereby granted, provided that the above copyright notice and this permission notice appear in all "
            "copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
                "the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]


def words_of(text: Column) -> Column:
    spaced = F.trim(F.regexp_replace(ascii_lower(text), "[^a-z0-9]+", " "))
    return F.split(spaced, " ", -1)


def bigrams_of(words: Column) -> Column:
    """Set of the word bigrams; none for fewer than two words."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
                       F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
                       lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(pairs)


def normal_words(text: str) -> list[str]:
    """The same normalisation for a template, at plan time."""
    kept = [c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.lower()]
    return "".join(kept).split()


def template_rows(templates: list[tuple[str, str]]) -> list[tuple[int, str, list[str]]]:
    """``(number, SPDX id, bigrams)`` of each template."""
    rows = []
    for number, (name, wording) in enumerate(templates):
        words = normal_words(wording)
        rows.append((number, name, sorted({f"{a} {b}" for a, b in zip(words, words[1:])})))
    return rows


def hits_of(words: Column, rows: list[tuple[int, str, list[str]]]) -> Column:
    """``(at, gram)`` of the bigrams of ``words``, a column's array, that any template has."""
    grams = sorted({g for _, _, own in rows for g in own})
    first, second = (sorted({g.split(" ")[i] for g in grams}) for i in (0, 1))
    found = F.transform(words, lambda w, i: F.when(
        w.isin(first) & F.get(words, i + 1).isin(second),
        F.struct(i.alias("at"), F.concat_ws(" ", w, F.get(words, i + 1)).alias("gram"))))
    return F.filter(found, lambda h: h["gram"].isin(grams))


def runs_of(words: Column, hits: Column, known: Column, threshold: float) -> Column:
    """Best run of each start and template, from ``threshold`` on: ``(from, worse, shorter, n, name, to)``."""
    def run(t: Column, h: Column, a: Column, b: Column) -> Column:
        to = F.get(t["hits"], b)["at"]
        own = F.transform(F.sequence(h["at"], to), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))
        shared = F.array_distinct(F.slice(t["hits"]["gram"], a + 1, b - a + 1))
        score = F.lit(2.0) * F.size(shared) / (F.size(F.array_distinct(own)) + t["size"])
        return F.struct(h["at"].alias("from"), (-score).alias("worse"), (h["at"] - to).alias("shorter"),
                        t["n"].alias("n"), t["name"].alias("name"), (to + 1).alias("to"))

    def best_from(t: Column, h: Column, a: Column) -> Column:
        last = F.least(F.size(t["hits"]), a + t["reach"]) - 1
        ends = F.filter(F.sequence(a + t["need"] - 1, last), lambda b: F.get(t["hits"], b)["at"] - h["at"] < t["reach"])
        return F.array_min(F.filter(F.transform(ends, lambda b: run(t, h, a, b)), lambda r: r["worse"] <= -threshold))

    def dense(t: Column, h: Column, a: Column) -> Column:
        return F.get(t["hits"], a + t["need"] - 1)["at"] - h["at"] < t["reach"]

    with_hits = F.transform(known, lambda t: F.struct(
        t["n"].alias("n"), t["name"].alias("name"), t["size"].alias("size"), t["need"].alias("need"),
        t["reach"].alias("reach"), F.filter(hits, lambda h: F.array_contains(t["grams"], h["gram"])).alias("hits")))
    near = F.filter(with_hits, lambda t: F.size(t["hits"]) >= t["need"])
    runs = F.flatten(F.transform(near, lambda t: F.transform(
        t["hits"], lambda h, a: F.when(dense(t, h, a), best_from(t, h, a)))))
    return F.array_sort(F.filter(runs, lambda r: r.isNotNull()))


def matched_words(blocks: Column, best: Column) -> Column:
    """For each word of ``blocks``, an array of words each, whether its block has a ``best`` match."""
    none = F.array().cast("array<boolean>")
    return F.flatten(F.zip_with(blocks, best, lambda w, b: F.when(w[0] != "", F.array_repeat(b.isNotNull(), F.size(w)))
                                .otherwise(none)))


def scan_licenses(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD,
                  templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """``docs`` with ``license`` (best template's id or null), ``score`` (its Dice) and ``n_matches`` (blocks and runs).

    They stand at the end, in place of columns of these names.
    """
    rows = template_rows(TEMPLATES if templates is None else templates)
    least, most = threshold / (2 - threshold), (2 - threshold) / threshold
    smallest = min(len(grams) for _, _, grams in rows)
    # whole numbers of bigrams, rounded towards more runs
    need = {n: max(1, math.ceil(least * len(grams) - 1e-9)) for n, _, grams in rows}
    known = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(name).alias("name"), F.lit(len(grams)).alias("size"),
                               F.lit(need[n]).alias("need"), F.lit(int(most * len(grams) + 1e-9)).alias("reach"),
                               F.array(*map(F.lit, grams)).alias("grams")) for n, name, grams in rows])
    no_words, no_block = F.array().cast("array<string>"), F.array().cast("array<array<string>>")

    def best_of(block: Column) -> Column:
        """Best (score, -number, name) of a block's set of bigrams, null below the threshold."""
        near = F.filter(known, lambda t: (F.size(block) >= least * t["size"]) & (F.size(block) <= most * t["size"]))
        scored = F.transform(near, lambda t: F.struct(
            (F.lit(2.0) * F.size(F.array_intersect(block, t["grams"])) / (F.size(block) + t["size"])).alias("score"),
            (-t["n"]).alias("rank"), t["name"].alias("name")))
        return F.array_max(F.filter(scored, lambda s: s["score"] >= threshold))

    def best_of_each(blocks: Column) -> Column:
        return F.transform(F.transform(blocks, lambda w: F.when(F.size(w) > least * smallest, bigrams_of(w))
                                       .otherwise(no_words)), best_of)

    text = text_or_empty(F.col(text_col))
    paragraphs = F.split(text, "\n[ \t]*\n\\s*", -1)
    own = [c for c in docs.columns if c not in ("license", "score", "n_matches")]
    # a paragraph of one line is compared as that line
    several = F.transform(paragraphs, lambda p: F.struct(p.contains("\n").alias("several"), words_of(p).alias("words")))
    split = docs.select(F.struct(*own).alias("_doc"), F.transform(F.split(text, "\n", -1), words_of).alias("_lines"),
                        F.when(F.size(paragraphs) > 1, several).alias("_paras"))
    compared = split.select(
        "_doc", "_lines", "_paras", best_of_each(F.col("_lines")).alias("_of_lines"),
        best_of_each(F.transform("_paras", lambda p: F.when(p["several"], p["words"]).otherwise(no_words)))
        .alias("_of_paras"), F.flatten(F.filter("_lines", lambda w: w[0] != "")).alias("_words"))
    found = compared.select("*", hits_of(F.col("_words"), rows).alias("_hits"))
    enough = F.size("_hits") >= min(need.values())
    whole = F.when(enough & F.col("_paras").isNull() & (F.size("_lines") > 1), F.array("_words")).otherwise(no_block)
    measured = found.select("*", F.when(enough, runs_of(F.col("_words"), F.col("_hits"), known, threshold)).alias("_runs"),
                            best_of_each(whole).alias("_of_whole"))
    in_lines = matched_words(F.col("_lines"), F.col("_of_lines"))
    in_paras = matched_words(F.col("_paras")["words"], F.col("_of_paras"))
    marked = measured.select("*", F.when(F.size("_runs") > 0, F.when(F.col("_paras").isNull(), in_lines).otherwise(
        F.zip_with(in_lines, in_paras, lambda a, b: a | b))).alias("_taken"))
    free = F.filter("_runs", lambda r: ~F.exists(F.slice("_taken", r["from"] + 1, r["to"] - r["from"] + 1), lambda x: x))
    n_runs = F.aggregate(free, F.struct(F.lit(-1).alias("to"), F.lit(0).alias("n")), lambda s, r: F.when(
        r["from"] > s["to"], F.struct(r["to"].alias("to"), (s["n"] + 1).alias("n"))).otherwise(s), lambda s: s["n"])
    hits = F.filter(F.concat("_of_lines", F.coalesce("_of_paras", F.array().cast(compared.schema["_of_lines"].dataType))),
                    lambda b: b.isNotNull())
    of_runs = F.transform("_runs", lambda r: F.struct((-r["worse"]).alias("score"), (-r["n"]).alias("rank"),
                                                      r["name"].alias("name")))
    scored = marked.select("_doc", "_of_whole", hits.alias("_hits"), F.array_max(of_runs).alias("_run"),
                           F.coalesce(n_runs, F.lit(0)).alias("_n_runs"))
    best = scored.select("_doc", F.greatest(F.array_max("_hits"), F.array_max("_of_whole"), "_run").alias("_best"),
                         F.greatest(F.size("_hits") + F.col("_n_runs"),
                                    F.array_max("_of_whole").isNotNull().cast("int")).cast("long").alias("n_matches"))
    return best.select(*[F.col("_doc")[c].alias(c) for c in own], F.col("_best")["name"].alias("license"),
                       F.coalesce(F.col("_best")["score"], F.lit(0.0)).alias("score"), "n_matches")


def oracle(threshold: float = THRESHOLD) -> str:
    """DuckDB SQL of ``op10``: the same blocks, sets and pruning bounds, over lines and paragraphs."""
    values = ", ".join(f"({n}, '{name}', {len(grams)}, {grams!r})" for n, name, grams in template_rows(TEMPLATES))
    return f"""
WITH known(n, name, size, grams) AS (VALUES {values}),
parts AS (SELECT doc_id, coalesce(text, '') AS text, regexp_split_to_array(coalesce(text, ''), '\\n[ \\t]*\\n\\s*') AS paras
          FROM documents),
blocks AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS block FROM parts
  UNION ALL SELECT doc_id, block FROM (SELECT doc_id, paras, unnest(paras) AS block FROM parts)
            WHERE len(paras) > 1 AND contains(block, chr(10))),
worded AS (SELECT doc_id, row_number() OVER () AS b, string_split(trim(regexp_replace(translate(block,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM blocks),
grams AS (SELECT doc_id, b, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
          FROM worded WHERE len(w) > 1),
scored AS (SELECT doc_id, b, n, name, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + size) AS score
           FROM grams, known WHERE len(g) >= {threshold / (2 - threshold)!r} * size
                               AND len(g) <= {(2 - threshold) / threshold!r} * size),
hits AS (SELECT doc_id, b, max(score) AS top, arg_max(name, (score, -n)) AS name, arg_max(n, (score, -n)) AS n
         FROM scored WHERE score >= {threshold!r} GROUP BY doc_id, b),
best AS (SELECT doc_id, arg_max(name, (top, -n)) AS license, max(top) AS score, count(*) AS n_matches
         FROM hits GROUP BY doc_id)
SELECT d.doc_id, license, coalesce(score, 0.0) AS score, coalesce(n_matches, 0) AS n_matches
FROM documents d LEFT JOIN best USING (doc_id)"""
