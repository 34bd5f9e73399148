"""License scan by diagonal voting.

Every 3-word run of every document meets the runs of the license templates
(notices, grants and openings) in a Spark join.  A match at document
word ``p`` and template word ``t`` votes for diagonal ``p - t``.  Votes are
summed per diagonal; neighbouring diagonals (a word inserted or lost moves
the rest of a text to the next one) are merged; a merged span is verified by
the share of the template's runs that it covers and by its length.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripstats.llm.shingles import WIDTH, occurrences

# Fixed values of the contract: phrases whose exact places are counted.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Openings, grants and usual short notices of public licenses, lower-cased words.
TEMPLATES = {
    "licensed under the gnu general public license": "gpl",
    "distributed under the terms of the gnu general public license": "gpl",
    "you should have received a copy of the gnu general public license along with this program": "gpl",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied "
    "warranty of merchantability or fitness for a particular purpose": "gpl",
    "licensed under the gnu lesser general public license": "lgpl",
    "licensed under the gnu affero general public license": "agpl",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    "the software": "mit",
    "this software is released under the mit license": "mit",
    "licensed under the bsd 3 clause license": "bsd",
    "use of this source code is governed by a bsd style license": "bsd",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on "
    "an as is basis": "apache-2",
    "licensed under the mozilla public license version 2 0": "mpl-2",
    "this work is licensed under the creative commons attribution license": "cc-by",
    "dedicated to the public domain under the creative commons cc0 1 0 universal public domain dedication": "cc0",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and "
    "associated documentation files": "mit",
    "released under the terms of the mit license": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in "
    "compliance with the license": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted provided "
    "that the following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is "
    "hereby granted": "isc",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu "
    "general public license as published by the free software foundation": "gpl",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: Diagonals this close belong to one span.
NEIGHBOUR = 2
#: Share of a template's word runs that a span must cover.
COVER = 0.8
#: Words a span may be longer than its template, as a share.
STRETCH = 1.25


def template_rows(spark: SparkSession, base: dict[str, str], templates: dict[str, str]) -> DataFrame:
    rows = []
    for no, (text, label, is_base) in enumerate([(t, x, True) for t, x in base.items()] +
                                                [(t, x, False) for t, x in templates.items()]):
        w = text.split(" ")
        rows += [(no, label, is_base, len(w) - WIDTH + 1, i, " ".join(w[i:i + WIDTH]))
                 for i in range(len(w) - WIDTH + 1)]
    return spark.createDataFrame(rows, "template int, label string, base boolean, runs int, at int, gram string")


def scan(docs: DataFrame, base: dict[str, str] | None = None, templates: dict[str, str] | None = None
         ) -> tuple[DataFrame, DataFrame]:
    """``(documents, spans)``: spans are ``(row, template, label, base, first_word,
    end_word, n_exact, first_exact, last_exact, cover)`` of each merged group of diagonals."""
    tpl = template_rows(docs.sparkSession, BASE if base is None else base,
                        TEMPLATES if templates is None else templates)
    seen = occurrences(docs, tpl.select("gram").distinct(), [WIDTH])
    votes = seen.where("pos >= 0").join(F.broadcast(tpl), "gram")      # the templates are constants
    diagonals = (votes.withColumn("diagonal", F.col("pos") - F.col("at"))
                 .groupBy("row", "template", "label", "base", "runs", "diagonal")
                 .agg(F.count("*").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"),
                      F.collect_list("at").alias("ats")))           # at most the template's runs
    w = Window.partitionBy("row", "template").orderBy("diagonal")
    # an exact place of a base phrase fills its diagonal and stays a span of its own
    apart = (F.col("diagonal") - F.lag("diagonal").over(w) > NEIGHBOUR) | F.col("base")
    grouped = diagonals.withColumn("span", F.sum(F.coalesce(apart.cast("int"), F.lit(0))).over(w))
    exact = F.col("votes") == F.col("runs")
    return seen.where("pos < 0"), (
        grouped.groupBy("row", "template", "label", "base", "runs", "span")
        .agg(F.min("first").alias("first_word"), (F.max("last") + WIDTH).alias("end_word"),
             F.sum(exact.cast("long")).alias("n_exact"),
             F.min(F.when(exact, F.col("diagonal"))).alias("first_exact"),
             F.max(F.when(exact, F.col("diagonal"))).alias("last_exact"),
             F.max("votes").alias("best"),
             F.collect_list("ats").alias("ats"))
        .withColumn("cover", F.size(F.array_distinct(F.flatten("ats"))) / F.col("runs")).drop("ats"))


def label_documents(docs: DataFrame, base: dict[str, str] | None = None, templates: dict[str, str] | None = None,
                    cover: float = COVER, stretch: float = STRETCH) -> DataFrame:
    """License labels of every document.

    ``docs`` needs ``doc_id, text``; other columns are ignored.  Returns one
    row per input row: ``doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score``.

    ``n_base`` counts all exact places of base phrases, ``first_word`` and
    ``last_word`` are their smallest and largest start.  ``labels`` adds those
    of template spans that cover at least ``cover`` of the template within
    ``stretch`` times its length.  ``score`` is the best share of a template
    covered, 1 with a base place, 0 without any vote.  Null, empty and
    wordless texts have no labels (empty strings), null places and score 0.
    """
    every, spans = scan(docs, base, templates)
    fits = ~F.col("base") & (F.col("cover") >= cover) & (
        F.col("end_word") - F.col("first_word") <= stretch * (F.col("runs") + WIDTH - 1))
    exact = F.col("base") & (F.col("n_exact") > 0)
    per = spans.groupBy("row").agg(
        F.sum(F.when(exact, F.col("n_exact"))).alias("n_base"),
        F.min(F.when(exact, F.col("first_exact"))).alias("first_word"),
        F.max(F.when(exact, F.col("last_exact"))).alias("last_word"),
        F.collect_set(F.when(exact, F.col("label"))).alias("base_set"),
        F.collect_set(F.when(exact | fits, F.col("label"))).alias("all_set"),
        F.max(F.when(exact | fits, F.least(F.col("cover"), F.lit(1.0)))
              .otherwise(F.least(F.col("best") / F.col("runs"), F.lit(1.0)))).alias("score"))

    def joined(c):
        return F.concat_ws(",", F.array_sort(F.coalesce(F.col(c), F.array().cast("array<string>"))))
    return (every.join(per, "row", "left")
            .select("doc_id", F.col("n_words").cast("long").alias("n_words"),
                    F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
                    F.col("first_word").cast("long").alias("first_word"),
                    F.col("last_word").cast("long").alias("last_word"),
                    joined("base_set").alias("base_labels"), joined("all_set").alias("labels"),
                    F.coalesce("score", F.lit(0.0)).alias("score")))
