"""License scans by diagonal voting; DataFrame operations only.

Rolling hashes of all word k-grams of every text are joined to the k-grams of the templates (a fixed
table). A hit at document word i and template word j votes for the diagonal i - j. Votes are counted
by diagonal once the words themselves have been compared; neighbouring diagonals (a few words put in
or left out) merge into spans, and a span's score is the share of the template's k-grams found in it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirstone.llm._spark import cut

#: Words in a k-gram.
GRAM = 3

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """``drift``: how far diagonals may lie apart and still be one span; 0 for phrases, of which each place counts."""

    label: str
    text: str
    drift: int = 4
    base: bool = False

    @property
    def words(self) -> list[str]:
        return re.findall(WORD, self.text.translate(str.maketrans(UPPER, LOWER)))


#: Phrases and their labels.
PHRASES = [
    Template("mit", "under the mit license", 0, True),
    Template("apache-2", "apache license version 2", 0, True),
    Template("cc-by-nc", "cc by nc", 0, True),
]

#: Notices as published with the licenses.
NOTICES = [
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    Template("mit", "released under the MIT License"),
    Template("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    Template("apache-2", "licensed under the Apache License, Version 2.0"),
    Template("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    Template("gpl-3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    Template("gpl-2", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    Template("cc-by-nc", "licensed under CC BY-NC 4.0"),
    Template("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    Template("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
]


def template_grams(spark, templates: Sequence[Template]) -> DataFrame:
    """(gram, template, place): as many rows as the templates have words, at most."""
    rows = [(t, j, words[j : j + GRAM]) for t, x in enumerate(templates) for words in [x.words] for j in range(len(words) - GRAM + 1)]
    held = spark.createDataFrame(rows, "template int, place int, gram_words array<string>")
    return held.select(F.xxhash64(*(F.col("gram_words")[i] for i in range(GRAM))).alias("gram"), "template", "place", "gram_words")


def scan(docs: DataFrame, templates: Sequence[Template] = (*PHRASES, *NOTICES), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, spans (label, base, first, last, score), by first word and label.

    first and last are the span's first and last word, from 0; score is the share of the template's
    k-grams that stand there in order, up to ``drift`` words off. A null or empty text has no words
    and no spans. Rows that agree in id and text have the same spans. Templates need three words.
    """
    if short := [t.text for t in templates if len(t.words) < GRAM]:
        raise ValueError(f"templates of under {GRAM} words: {short}")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("hash"), F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), 0).alias("words"))
    gram = ", ".join(f"words[i + {k}]" for k in range(GRAM))
    # The last entry stands for the row itself, so that rows without hits stay.
    grams = F.expr(f"concat(if(size(words) < {GRAM}, array(), transform(sequence(0, size(words) - {GRAM}), i -> xxhash64({gram}))), array(0L))")
    rows = rows.select("doc_id", "hash", "words", F.posexplode(grams).alias("at", "gram"))
    table = template_grams(spark, templates).union(spark.createDataFrame([(0, -1, 0, None)], "gram long, template int, place int, gram_words array<string>"))
    hits = rows.join(F.broadcast(table), "gram")
    itself = (F.col("template") == -1) & (F.col("at") == F.greatest(F.size("words") - GRAM + 1, F.lit(0)))
    spelt = (F.col("template") >= 0) & (F.slice("words", F.col("at") + 1, GRAM) == F.col("gram_words"))
    hits = cut(hits.where(itself | spelt).select("doc_id", "hash", "template", "at", "place", F.size("words").cast("long").alias("n_words")))

    kinds = spark.createDataFrame([(t, x.label, x.base, x.drift, len(x.words) - GRAM + 1) for t, x in enumerate(templates)], "template int, label string, base boolean, drift int, grams int")
    votes = hits.where("template >= 0").groupBy("doc_id", "hash", "template", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.collect_set("place").alias("places"))
    votes = votes.join(F.broadcast(kinds), "template")
    near = Window.partitionBy("doc_id", "hash", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(near) > F.col("drift"), F.lit(True))
    votes = votes.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(near))
    first, last = F.min(F.col("diagonal") + F.array_min("places")), F.max(F.col("diagonal") + F.array_max("places") + GRAM - 1)
    found = F.size(F.array_distinct(F.flatten(F.collect_list("places"))))
    spans = votes.groupBy("doc_id", "hash", "template", "span", "label", "base", "grams").agg(first.cast("long").alias("first"), last.cast("long").alias("last"), found.alias("found"))
    # A phrase counts where all of it stands.
    spans = spans.withColumn("score", F.col("found") / F.col("grams")).where("not base or found = grams")
    spans = spans.groupBy("doc_id", "hash").agg(F.array_sort(F.collect_list(F.struct("first", "label", "base", "last", "score"))).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("d"), F.col("hash").alias("h"), "spans")
    every = hits.where("template = -1").select("doc_id", "hash", "n_words")
    out = every.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h")), "left")
    return out.select("doc_id", "n_words", F.coalesce("spans", F.expr("array()").cast(spans.schema["spans"].dataType)).alias("spans"))
