"""License scan (operator 1): diagonal voting, DataFrame functions only.

Every rolling ``K``-word window of every text is hashed and joined to the template
positions that hold the same words. A hit votes for the diagonal ``text position -
template position``; votes are a bit set of template positions, so they add up with a
bitwise OR. Neighbouring diagonals (words put in or left out) are merged, and a merged span counts when
enough of its template's windows were seen inside a span of the template's own size.

The template table is a fixed constant of this module, so its broadcast has a fixed size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterline.llm.common import save

K = 3
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PARTING = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what stands between lower-case words
# Diagonals of one template that lie this close belong to one span.
GAP = 8
# Least share of a template's windows, and greatest length of a span against its template.
MIN_COVER = 0.75
MAX_STRETCH = 1.5

# The base phrases and their labels.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
# Opening words of public licences and notices; at most 64 windows each.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial "
            "portions of the software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license as published by the "
            "free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def template_rows(base=BASE, more=TEMPLATES) -> list[tuple]:
    """``(tid, label, is_base, n_grams, n_template_words, tpos, w0, w1, w2)`` for every window of every template."""
    rows = []
    for tid, (label, phrase) in enumerate((*base, *more)):
        words = phrase.split()
        n = len(words) - K + 1
        if not 1 <= n <= 64:
            raise ValueError("a template has 1 to 64 windows")
        rows += [(tid, label, tid < len(base), n, len(words), i, *words[i:i + K]) for i in range(n)]
    return rows


def _templates(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    schema = "tid int, label string, is_base boolean, n_grams int, n_template int, tpos int, t0 string, t1 string, t2 string"
    return spark.createDataFrame(rows, schema).withColumn("gram", F.xxhash64("t0", "t1", "t2"))


def lower_ascii(text):
    """A-Z to lower case. Other letters change too, but never into or out of an ASCII word: the
    one sign whose lower case is ASCII (the Kelvin sign) is first replaced by another letter."""
    return F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u00e9")))


def votes(docs: DataFrame, base=BASE, more=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text, template and diagonal with its votes, and one row per text without a template.

    ``(doc_id, h, n_words, tid, label, is_base, n_grams, n_template, diag, cover, lo, hi, n_rows)``; ``h`` is a digest of
    the text, so rows that share an id stay apart unless they are equal (``n_rows``).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"),
                         F.trim(F.regexp_replace(lower_ascii(text), PARTING, " ")).alias("norm"))
             .select("doc_id", "h", F.when(F.col("norm") == "", F.array().cast("array<string>"))
                     .otherwise(F.split("norm", " ")).alias("words")))
    n_words = F.size("words")
    # position -1 is the text itself; 0 .. n-K are its windows
    placed = words.select("doc_id", "h", "words", n_words.alias("n_words"),
                          F.explode(F.sequence(F.lit(-1), F.greatest(n_words - K, F.lit(-1)))).alias("pos"))

    def word(i):
        return F.get("words", F.col("pos") + i)

    grams = placed.withColumn("gram", F.when(F.col("pos") >= 0, F.xxhash64(word(0), word(1), word(2))))
    temp = _templates(docs.sparkSession, template_rows(base, more)).alias("t")
    same = ((grams["gram"] == F.col("t.gram")) & (word(0) == F.col("t0")) & (word(1) == F.col("t1"))
            & (word(2) == F.col("t2")))
    hits = grams.join(F.broadcast(temp), same, "left").where("pos = -1 OR tid IS NOT NULL")
    return (hits.groupBy("doc_id", "h", "n_words", "tid", "label", "is_base", "n_grams", "n_template",
                         (F.col("pos") - F.col("tpos")).alias("diag"))
            .agg(F.bit_or(F.expr("shiftleft(1L, tpos)")).alias("cover"), F.min("pos").alias("lo"),
                 (F.max("pos") + K).alias("hi"), F.count(F.lit(1)).alias("n_rows")))


def spans(voted: DataFrame) -> DataFrame:
    """Merged diagonals: ``(doc_id, h, tid, label, is_base, lo, hi, places, first, last, share, found)``."""
    order = Window.partitionBy("doc_id", "h", "tid").orderBy("diag")
    merged = (voted.where("tid IS NOT NULL")
              .withColumn("new", (F.col("diag") - F.lag("diag").over(order) > GAP).cast("int"))
              .withColumn("grp", F.sum(F.coalesce("new", F.lit(0))).over(
                  order.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    whole = F.bit_count("cover") == F.col("n_grams")
    agg = merged.groupBy("doc_id", "h", "tid", "label", "is_base", "n_grams", "n_template", "grp").agg(
        F.bit_or("cover").alias("cover"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.max(F.bit_count("cover")).alias("best"), F.count_if(whole).alias("places"),
        F.min(F.when(whole, F.col("diag"))).alias("first"), F.max(F.when(whole, F.col("diag"))).alias("last"))
    fits = F.col("hi") - F.col("lo") <= F.ceil(F.col("n_template") * MAX_STRETCH)
    seen = F.when(fits, F.bit_count("cover")).otherwise(F.col("best"))
    return (agg.withColumn("share", seen / F.col("n_grams"))
            .withColumn("found", F.col("share") >= MIN_COVER)
            .select("doc_id", "h", "tid", "label", "is_base", "lo", "hi", "places", "first", "last", "share", "found"))


def scan(docs: DataFrame, base=BASE, more=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    Null and empty texts have no words, no labels and score 0. Repeated rows each get their
    row; null ids are kept. ``score`` is the greatest share of a template's windows seen in
    one span. Columns other than the two named are ignored. Empty input gives no rows.
    """
    voted = save(votes(docs, base, more, id_col, text_col), "license-votes")
    found = spans(voted).groupBy("doc_id", "h").agg(
        F.sum(F.when(F.col("is_base"), F.col("places"))).alias("n_base"),
        F.min(F.when(F.col("is_base"), F.col("first"))).alias("first_word"),
        F.max(F.when(F.col("is_base"), F.col("last"))).alias("last_word"),
        F.collect_set(F.when(F.col("is_base") & (F.col("places") > 0), F.col("label"))).alias("base_set"),
        F.collect_set(F.when(F.col("found") | (F.col("is_base") & (F.col("places") > 0)), F.col("label"))).alias("set"),
        F.max("share").alias("score"))
    texts = voted.where("tid IS NULL").select("doc_id", "h", "n_words", "n_rows")
    joined = texts.alias("d").join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id"))
                                   & (F.col("d.h") == F.col("f.h")), "left")

    def listed(name):
        return F.coalesce(F.array_join(F.array_sort(name), ","), F.lit(""))

    return joined.select(
        "d.doc_id", F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        listed("base_set").alias("base_labels"), listed("set").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))).alias("copy")).drop("copy")


def oracle_sql(base=BASE, more=TEMPLATES) -> str:
    values = ", ".join("(%d, '%s', %s, %d, %d, %d, '%s', '%s', '%s')" % row for row in template_rows(base, more))
    return f"""
WITH t(tid, label, is_base, n_grams, n_template, tpos, t0, t1, t2) AS (VALUES {values}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
g AS (SELECT doc_id, p AS pos, w[p + 1] AS w0, w[p + 2] AS w1, w[p + 3] AS w2
      FROM (SELECT doc_id, w, unnest(range(len(w) - {K} + 1)) AS p FROM d)),
v AS (SELECT doc_id, tid, label, is_base, n_grams, n_template, pos - tpos AS diag, bit_or(1::BIGINT << tpos) AS cover,
        min(pos) AS lo, max(pos) + {K} AS hi
      FROM g JOIN t ON w0 = t0 AND w1 = t1 AND w2 = t2 GROUP BY ALL),
m AS (SELECT *, sum(CASE WHEN gap > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, tid ORDER BY diag) AS grp
      FROM (SELECT *, diag - lag(diag) OVER (PARTITION BY doc_id, tid ORDER BY diag) AS gap FROM v)),
s AS (SELECT doc_id, tid, label, is_base, n_grams, n_template, grp, bit_count(bit_or(cover)) AS all_seen,
        max(bit_count(cover)) AS best, min(lo) AS lo, max(hi) AS hi,
        count(*) FILTER (WHERE bit_count(cover) = n_grams) AS places,
        min(diag) FILTER (WHERE bit_count(cover) = n_grams) AS first,
        max(diag) FILTER (WHERE bit_count(cover) = n_grams) AS last FROM m GROUP BY ALL),
h AS (SELECT *, (CASE WHEN hi - lo <= ceil(n_template * {MAX_STRETCH}) THEN all_seen ELSE best END)::DOUBLE / n_grams AS share
      FROM s),
f AS (SELECT doc_id, sum(places) FILTER (WHERE is_base) AS n_base, min(first) FILTER (WHERE is_base) AS first_word,
        max(last) FILTER (WHERE is_base) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE is_base AND places > 0) AS base_labels,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE share >= {MIN_COVER} OR is_base AND places > 0) AS labels,
        max(share) AS score FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN f USING (doc_id)"""
