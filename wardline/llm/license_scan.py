"""License scans by diagonal voting, in DataFrame functions only.

All rolling word k-grams of a document are hashed and joined with the positions of the same
hashes in license templates. A match votes for the diagonal (word position minus template
position). A phrase stands where one diagonal has all of its k-grams; for a longer notice,
neighbouring diagonals are merged, so that inserted or missing words do not break it.

Matches are verified twice: a k-gram by its words, and a merged place by its order. Of a place, each template k-gram counts
at its first word in the document, and only if it stands after all earlier ones of the template; the share that does is the coverage.

Defined cases: null and empty texts have no words, null places and empty label lists; a null
doc_id stays null; identical rows give identical rows; an empty table gives an empty result; other columns
are not read. A row of the join holds its own k words, never the text, so the work grows with the words of a text. No row goes beyond the join
unless it matched, and what a document's group holds is bounded by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NO_ID, SEP_RE, ascii_lower, id_and_text, split_words

K = 3
#: Diagonals at most this far apart belong to one place of a notice.
MAX_GAP = 4
#: Share of a notice's k-grams that must be found.
MIN_COVERAGE = 0.8
#: Length of the arrays that give repeated rows back.
COPIES_AT_ONCE = 10_000
#: The template table is broadcast; more k-grams than this are an error of configuration.
MAX_TEMPLATE_GRAMS = 200_000
#: Phrases whose every place counts, by label.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
#: Notices in common use, by label, as lower-case words.
NOTICES = (
    ("gpl-3", "gnu general public license version 3"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl", "gnu lesser general public license version"),
    ("agpl-3", "gnu affero general public license version 3"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction",
    ),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("boost-1", "boost software license version 1 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("reserved", "all rights reserved no part of this publication may be reproduced"),
)


def templates() -> list[tuple[int, str, bool, list[str]]]:
    """(number, label, base phrase or not, words)"""
    both = [(label, True, t) for label, t in PHRASES.items()] + [(label, False, t) for label, t in NOTICES]
    return [(i, label, base, text.split()) for i, (label, base, text) in enumerate(both)]


def _grams(spark, temps) -> DataFrame:
    rows = [(n, label, base, j, len(w) - K + 1, " ".join(w[j : j + K])) for n, label, base, w in temps for j in range(len(w) - K + 1)]
    if len(rows) > MAX_TEMPLATE_GRAMS:
        raise ValueError(f"{len(rows)} template k-grams; the limit is {MAX_TEMPLATE_GRAMS}")
    # A row of its own that every document matches once carries the document through the join.
    t = spark.createDataFrame([*rows, (-1, "", False, 0, 0, "")], "t_no int, label string, base boolean, t_pos int, t_grams int, t_gram string")
    return t.withColumn("t_hash", F.xxhash64("t_gram"))


def _hits(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    d = id_and_text(docs, id_col, text_col).select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("__id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("__text_key"),
        split_words(ascii_lower(F.coalesce("text", F.lit(""))), SEP_RE).alias("words"),
    )
    gram = lambda i: F.array_join(F.slice("words", i, K), " ")
    grams = F.when(F.size("words") >= K, F.transform(F.sequence(F.lit(1), F.size("words") - (K - 1)), gram)).otherwise(F.array().cast("array<string>"))
    # No k-gram is empty: the one ahead of the others is the document's own mark.
    d = d.select("__id", "__text_key", F.size("words").alias("n_words"), F.concat(F.array(F.lit("")), grams).alias("grams"))
    # Only what is named here goes with each k-gram. The outer form, since for the inner one the optimiser adds a test that
    # the array has entries, and that would split the text anew for each k-gram.
    d = d.select("__id", "__text_key", "n_words", F.posexplode_outer("grams").alias("p", "gram"))
    t = F.broadcast(_grams(docs.sparkSession, templates()))
    return (
        d.withColumn("d_hash", F.xxhash64("gram"))
        .join(t, F.col("d_hash") == F.col("t_hash"))
        .where(F.col("gram") == F.col("t_gram"))
        .select("__id", "__text_key", "n_words", "t_no", "label", "base", "t_pos", "t_grams", (F.col("p") - 1).alias("pos"), (F.col("p") - 1 - F.col("t_pos")).alias("diag"))
    )


def _spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    key = ["__id", "__text_key"]
    # Repeats of a row are counted before they meet under their key, which a third of a table may share. After that one shuffle
    # whatever is grouped or ordered below is dealt by the document already.
    hits = _hits(docs, id_col, text_col)
    hits = hits.groupBy(*hits.columns).agg(F.count(F.lit(1)).alias("rows")).repartition(*key)
    order = Window.partitionBy(*key, "t_no").orderBy("diag", "t_pos")
    # Each base diagonal is a place of its own; near diagonals of a notice are one.
    step = F.col("diag") - F.lag("diag").over(order)
    place = F.sum(F.when(step <= F.when(F.col("base"), 0).otherwise(MAX_GAP), 0).otherwise(1)).over(order)
    of = [*key, "t_no", "label", "base", "t_grams", "place"]
    first = hits.withColumn("place", place).groupBy(*of, "t_pos").agg(F.min("pos").alias("pos"), F.min("diag").alias("diag"), F.max("n_words").alias("n_words"), F.sum("rows").alias("n"))
    before = Window.partitionBy(*of).orderBy("t_pos").rowsBetween(Window.unboundedPreceding, -1)
    ordered = first.withColumn("in_order", F.col("pos") > F.coalesce(F.max("pos").over(before), F.lit(-2)))
    spans = ordered.groupBy(*of).agg(F.min("pos").alias("first_word"), F.count_if("in_order").alias("found"), F.max("n_words").alias("n_words"), F.max("n").alias("n"))
    return spans.withColumn("coverage", F.when(F.col("t_no") >= 0, F.col("found") / F.col("t_grams")).otherwise(0.0))


def places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each verified place: doc_id, label, base, first_word, coverage."""
    s = _spans(docs, id_col, text_col).where("t_no >= 0").where((F.col("base") & (F.col("coverage") == 1.0)) | (~F.col("base") & (F.col("coverage") >= MIN_COVERAGE)))
    return s.select(F.expr(f"nullif(__id, {NO_ID})").alias("doc_id"), "label", "base", "first_word", "coverage")


def label(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; a row for each row of the table."""
    key = ["__id", "__text_key"]
    spans = _spans(docs, id_col, text_col)
    base_hit = F.col("base") & (F.col("coverage") == 1.0)
    any_hit = base_hit | (~F.col("base") & (F.col("coverage") >= MIN_COVERAGE))
    out = spans.groupBy(*key).agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count_if(base_hit).cast("long").alias("n_base"),
        F.min(F.when(base_hit, F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(base_hit, F.col("first_word"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base_hit, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(any_hit, F.col("label")))), ",").alias("labels"),
        F.round(F.max("coverage"), 6).alias("score"),
        F.max(F.when(F.col("t_no") < 0, F.col("n"))).alias("copies"),
    )
    # Rows that are identical met under one key; give each its row back.
    some = F.lit(COPIES_AT_ONCE)
    out = out.withColumn("__left", F.explode(F.sequence("copies", F.lit(1).cast("long"), -some.cast("long"))))
    out = out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.least("__left", some).cast("int"))))
    return out.select(F.expr(f"nullif(__id, {NO_ID})").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
