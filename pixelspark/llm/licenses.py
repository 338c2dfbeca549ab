"""License texts by diagonal voting, and license names by phrase.

Every document's rolling hashes of GRAM words are joined to the positions of the same hashes in the templates. A hit votes
for its diagonal (word position minus template position); votes are added up per document, template and diagonal, runs
of neighbouring diagonals (a word inserted or left out moves the rest by one) are merged, and a merged span is verified:
enough of the template's positions must be hit, over a span about as long. The template table has a fixed size and is
broadcast. Everything is DataFrame expressions.

Base labels come from phrases of consecutive words (PHRASES); the method's labels are the templates' names.

Defined results: null and empty text have no words and no labels (empty strings), null first and last word, score 0; a
null doc_id stays null; repeated rows get equal results, one row each; a very long text is taken whole, its words being one
array in a row and its word positions rows of their own; a template that stands in a text several times, or ties with another one, is
named once each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GRAM, GAP = 4, 3
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The phrases of the contract.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
#: Headers, notices and paragraphs of public licenses, as texts hold them on their own.
TEMPLATES = {
    "agpl-text": "GNU Affero General Public License",
    "apache-text": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    "cc-by-text": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "gpl-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "lgpl-text": "GNU Lesser General Public License",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "mit-warranty": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "mpl-text": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
}
#: The short names of the Creative Commons family, by kind and version.
TEMPLATES |= {f"cc-{kind}-{version}": f"CC {kind} {version}" for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd") for version in ("1.0", "2.0", "2.5", "3.0", "4.0")}


def words_of(text: Column) -> Column:
    """Lower-cased words. lower() changes no character outside A-Z in a way that makes or breaks a word or phrase."""
    return F.array_remove(F.split(F.lower(text), NOT_WORD), "")


def grams(words: str) -> Column:
    """The hash of the GRAM words from each position on, of an array column of word hashes."""
    rolled = F.transform(words, lambda x, i: F.xxhash64(x, *(F.get(words, i + k) for k in range(1, GRAM))))
    return F.slice(rolled, 1, F.greatest(F.size(words) - (GRAM - 1), F.lit(0)))


def template_positions(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """gram, template, at, n_grams: one row per template position."""
    texts = spark.createDataFrame(sorted(templates.items()), "template string, text string")
    hashes = texts.select("template", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    hashes = hashes.select("template", grams("h").alias("g"))
    return hashes.select("template", F.size("g").alias("n_grams"), F.posexplode("g").alias("at", "gram"))


def spans(docs: DataFrame, templates: dict[str, str] = TEMPLATES, min_cover: float = 0.5) -> DataFrame:
    """doc_id, same (hash of the text), template, first, last (words), cover: the verified spans."""
    hashes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("same"), F.transform(words_of(F.coalesce("text", F.lit(""))), lambda w: F.xxhash64(w)).alias("h"))
    rolling = hashes.select("doc_id", "same", F.posexplode(grams("h")).alias("pos", "gram"))
    votes = rolling.join(F.broadcast(template_positions(docs.sparkSession, templates)), "gram")
    votes = votes.select("doc_id", "same", "template", "n_grams", "at", "pos", (F.col("pos") - F.col("at")).alias("diagonal"))
    key = ["doc_id", "same", "template"]
    diagonals = votes.groupBy(*key, "n_grams", "diagonal").agg(F.countDistinct("at").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    by = Window.partitionBy(*key).orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > GAP, F.lit(True)).cast("int")
    island = diagonals.withColumn("_new", new).withColumn("island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    merged = island.groupBy(*key, "n_grams", "island").agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), (F.max("last") + GRAM - 1).alias("last"))
    cover = F.least(F.lit(1.0), F.col("votes") / F.col("n_grams"))
    long = F.col("last") - F.col("first") + 1
    return merged.withColumn("cover", cover).where((F.col("cover") >= min_cover) & (long <= 1.5 * (F.col("n_grams") + GRAM - 1))).select(*key, "first", "last", "cover")


def phrase_marks(words: str) -> Column:
    """array<struct<label, at>>: the places of the phrases; `words` is an array column (null: none)."""

    def mark(w: Column, i: Column) -> Column:
        found = F.lit(None).cast("struct<label:string,at:int>")
        for label, phrase in PHRASES.items():
            *before, last = phrase.split()
            same = w == last
            for k, word in enumerate(reversed(before), 1):
                same = same & F.coalesce(F.get(words, i - k) == word, F.lit(False))
            found = F.when(same, F.struct(F.lit(label).alias("label"), (i - len(before)).cast("int").alias("at"))).otherwise(found)
        return found

    return F.filter(F.transform(words, mark), lambda m: m.isNotNull())


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, min_cover: float = 0.5) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("same"), words_of(text).alias("words"))
    endings = sorted({p.split()[-1] for p in PHRASES.values()})
    some = F.lit(False)
    for w in endings:
        some = some | F.array_contains("words", w)
    base = base.select("doc_id", "same", F.size("words").cast("long").alias("n_words"), F.when(some, F.col("words")).alias("_near"))
    base = base.withColumn("_marks", phrase_marks("_near")).drop("_near")
    base = base.select("doc_id", "same", "n_words", F.coalesce(F.size("_marks"), F.lit(0)).alias("_n"), F.array_distinct(F.coalesce(F.transform("_marks", lambda m: m["label"]), F.array().cast("array<string>"))).alias("_base"), F.array_min(F.transform("_marks", lambda m: m["at"])).cast("long").alias("first_word"), F.array_max(F.transform("_marks", lambda m: m["at"])).cast("long").alias("last_word"))
    found = spans(docs, templates, min_cover).groupBy(F.col("doc_id").alias("_doc"), F.col("same").alias("_same")).agg(F.collect_set("template").alias("_own"), F.max("cover").alias("_cover"))
    df = base.join(found, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("same") == F.col("_same")), "left")
    labels = F.array_sort(F.array_union("_base", F.coalesce("_own", F.array().cast("array<string>"))))
    score = F.when(F.size("_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_cover", F.lit(0.0)))
    return df.select("doc_id", "n_words", F.greatest(F.col("_n"), F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.array_join(F.array_sort("_base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _template_rows(templates: dict[str, str]) -> str:
    rows = []
    for name, text in sorted(templates.items()):
        words = [w for w in re.split("[^0-9a-z]+", text.lower()) if w]
        n = len(words) - GRAM + 1
        rows += [f"('{name}', {n}, {k}, '{' '.join(words[k : k + GRAM])}')" for k in range(n)]
    return ", ".join(rows)


#: The same rows in DuckDB, with words in place of hashes.
OP6_SQL = rf"""
with t(template, n_grams, spot, gram) as (values {_template_rows(TEMPLATES)}),
d as (select row_number() over () rid, doc_id, [x for x in string_split_regex(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> ''] ws from documents),
p as (select rid, i - 1 pos, ws[i] w, array_to_string(ws[i:i + {GRAM - 1}], ' ') gram, ws[i - 1] w1, ws[i - 2] w2 from (select rid, ws, unnest(range(1, len(ws) + 1)) i from d)),
m as (select rid, case when w1 = 'mit' then 'mit' when w1 = 'apache' then 'apache' else 'gpl' end label, case when w1 = 'public' then pos - 2 else pos - 1 end spot
  from p where w = 'license' and ((w1 in ('mit', 'apache') and pos >= 1) or (w1 = 'public' and w2 = 'general' and pos >= 2))),
b as (select rid, count(*) n, min(spot) f, max(spot) l, list_sort(list(distinct label)) labels from m group by rid),
v as (select rid, template, n_grams, pos - spot diagonal, count(distinct spot) votes, min(pos) f, max(pos) l from p join t using (gram) group by all),
i as (select *, sum(new) over (partition by rid, template order by diagonal) island from (select *, case when diagonal - lag(diagonal) over (partition by rid, template order by diagonal) <= {GAP} then 0 else 1 end new from v)),
s as (select rid, template, least(1.0, sum(votes)::double / n_grams) cover from i group by rid, template, n_grams, island having sum(votes)::double / n_grams >= 0.5 and max(l) + {GRAM - 1} - min(f) + 1 <= 1.5 * (n_grams + {GRAM - 1})),
o as (select rid, list(distinct template) own, max(cover) cover from s group by rid)
select doc_id, len(ws)::bigint n_words, coalesce(n, 0)::bigint n_base, f::bigint first_word, l::bigint last_word, coalesce(array_to_string(labels, ','), '') base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), coalesce(own, [])))), ','), '') labels, (case when labels is not null then 1.0 else coalesce(cover, 0.0) end)::double score
from d left join b using (rid) left join o using (rid)
"""
