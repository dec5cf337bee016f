"""License scans: TF-IDF cosine of header lines and licence files to templates, inherited along directories.

Every line of every file, and every few lines in a row, is a candidate header.  Those with a
cue get their cosine to each template; the idf of all their words comes from counts over all
files.  A file
whose words are mostly such lines, or that bears a licence file's name, is a licence file
and speaks for its directory.  A file without a licence of its own takes that of its nearest
ancestor directory that has one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small_side
from .common import pin

#: Notices by licence; a licence may have several.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("proprietary", "All rights reserved"),
)
#: Least cosine, least share of a licence file's words in matching lines, and words a template needs no line without.
LEAST_COSINE, FILE_SHARE = 0.6, 0.5
#: Lines that a wrapped notice runs over at most.
SPAN = 3
LICENCE_NAME = r"(?i)(?:^|/)(?:licen[cs]e|copying|notice|copyright)(?:\.[a-z0-9]+)?$"
WORD = r"[a-z0-9]+(?:\.[0-9]+)*"
#: Words that a matching line has at least one of.
CUES = r"(?i)licen[cs]|rights\s+reserved|permission|redistribution|creative\s+commons|mozilla|apache|gnu"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def template_terms(spark: SparkSession, templates) -> DataFrame:
    """(notice, license, term, tf) of the templates: as many rows as they have words."""
    rows = spark.createDataFrame([(i, name, notice) for i, (name, notice) in enumerate(templates)], "notice int, license string, said string")
    return rows.select("notice", "license", F.explode(terms(F.col("said"))).alias("term")).groupBy("notice", "license", "term").agg(F.count("*").alias("tf"))


def document_counts(files: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """(term, n) over all files: in how many files each term of ``wanted`` stands; the empty term counts the files.

    Terms are dropped that nobody asks for before anything moves, and the rest summed in each
    task.
    """
    words = F.array_distinct(terms(F.coalesce(F.col(text), F.lit(""))))
    held = files.select(F.explode(F.concat(words, F.array(F.lit("")))).alias("term"))
    return held.join(small_side(wanted), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def units(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, total, line, span, said): lines with a cue, and up to ``SPAN`` lines in a row that hold one and start or end with it.

    A notice that is wrapped over several lines is whole in one of these.  ``total`` are the
    words of the file, so no text needs to move.
    """
    cued = files.where(F.col(text).rlike(CUES)).select(key, F.size(terms(F.col(text))).alias("total"), F.split(text, "\n", -1).alias("lines"))
    places = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.get("lines", i).rlike(CUES))
    starts = cued.select(key, "total", "lines", F.explode(places).alias("at"))
    each = starts.select(key, "total", "lines", "at", F.explode(F.sequence(F.lit(1), F.lit(SPAN))).alias("span"))
    each = each.select(key, "total", "lines", "span", F.explode(F.array_distinct(F.array(F.col("at"), F.col("at") - F.col("span") + 1))).alias("line"))
    each = each.where((F.col("line") >= 0) & (F.col("line") + F.col("span") <= F.size("lines")))
    return each.select(key, "total", "line", "span", F.array_join(F.slice("lines", F.col("line") + 1, F.col("span")), "\n").alias("said")).distinct()


def header_matches(files: DataFrame, key: str, text: str, templates=TEMPLATES) -> DataFrame:
    """(key, license, cosine, words, total) of the headers whose best cosine reaches ``LEAST_COSINE``.

    A header is a line or a few lines in a row; of headers that overlap the best stays (ties:
    the shorter, then the first).  ``words`` are those of the header.  idf is
    log((1 + files) / (1 + files with the word)) + 1 for every word, counted over all files.
    """
    spark = files.sparkSession
    template = template_terms(spark, templates)
    place = [key, "total", "line", "span"]
    counted = pin(units(files, key, text).select(*place, F.explode(terms(F.col("said"))).alias("term")).groupBy(*place, "term").agg(F.count("*").alias("tf")))
    wanted = pin(counted.select("term").union(template.select("term")).union(spark.createDataFrame([("",)], "term string")).distinct())
    seen = pin(document_counts(files, wanted, text))
    total = seen.where("term = ''").agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    rated = pin(wanted.join(seen, "term", "left").select("term", (F.log((1 + total) / (1 + F.coalesce("n", F.lit(0)))) + 1).alias("idf")))
    weighted = template.join(rated, "term").select("notice", "license", "term", (F.col("tf") * F.col("idf")).alias("weight"))
    norms = weighted.groupBy("notice").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("norm"))
    rows = weighted.join(norms, "notice").select("notice", "license", "term", (F.col("weight") / F.col("norm")).alias("unit"))
    valued = counted.join(rated, "term").select(*place, "term", "tf", (F.col("tf") * F.col("idf")).alias("weight"))
    sizes = valued.groupBy(*place).agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("size"), F.sum("tf").alias("words"))
    dots = valued.join(F.broadcast(rows), "term").groupBy(*place, "notice", "license").agg(F.sum(F.col("weight") * F.col("unit")).alias("dot"))
    scored = dots.join(sizes, place).withColumn("cosine", F.round(F.col("dot") / F.col("size"), 6))
    best = scored.groupBy(*place, "words").agg(F.max(F.struct("cosine", "license")).alias("b")).where(F.col("b.cosine") >= LEAST_COSINE)
    # a header gives way to a better one among the lines that it covers
    covered = best.select(*place, "b", "words", F.explode(F.sequence(F.col("line"), F.col("line") + F.col("span") - 1)).alias("covers"))
    first = covered.groupBy(key, "covers").agg(F.min(F.struct(-F.col("b.cosine"), "span", "line")).alias("top"))
    held = covered.join(first, [key, "covers"]).withColumn("own", (F.col("top.span") == F.col("span")) & (F.col("top.line") == F.col("line")))
    kept = held.groupBy(*place, "words", "b").agg(F.bool_and("own").alias("kept")).where("kept")
    return kept.select(key, "b.license", "b.cosine", "words", "total")


def ancestors(folder: Column) -> Column:
    """A directory and all above it, nearest first; the top is the empty name."""
    steps = F.split(folder, "/", -1)
    return F.transform(F.sequence(F.size(steps), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))


def scan(files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text", templates=TEMPLATES) -> DataFrame:
    """(key, path, own_license, score, license, inherited_from) of every file.

    ``own_license`` is the licence of its best line (ties: the alphabetically last), ``license``
    that or else the one inherited from directory ``inherited_from``; all are null where
    nothing is found or the key is null.  A directory with several licence files takes the licence most of them
    have (ties: the alphabetically first).  Null texts have no licence, null paths no
    directory.  Rows that repeat a key share their matches; other columns are not read.
    """
    found = header_matches(files, key, text, templates)
    own = found.groupBy(key).agg(F.max(F.struct("cosine", "license")).alias("b"), F.sum("words").alias("matched"), F.max("total").alias("total"))
    own = pin(own.select(F.col(key).alias("_key"), F.col("b.license").alias("own_license"), F.col("b.cosine").alias("score"), (F.col("matched") >= FILE_SHARE * F.col("total")).alias("mostly")))
    folder = F.regexp_extract(F.col(path), "^(.*)/[^/]*$", 1)
    rows = files.select(key, path, folder.alias("_dir")).join(own, F.col(key) == F.col("_key"), "left").drop("_key")
    speaks = F.col("own_license").isNotNull() & (F.col(path).rlike(LICENCE_NAME) | F.col("mostly"))
    marked = pin(rows.withColumn("_speaks", speaks).drop("mostly"))
    votes = marked.where("_speaks and _dir is not null").groupBy("_dir", "own_license").agg(F.count("*").alias("n"))
    spoken = votes.groupBy("_dir").agg(F.min(F.struct(-F.col("n"), "own_license")).alias("b")).select(F.col("_dir").alias("above"), F.col("b.own_license").alias("told"))
    ways = marked.where("own_license is null and _dir is not null").select("_dir").distinct().select("_dir", F.posexplode(ancestors(F.col("_dir"))).alias("up", "above"))
    nearest = ways.join(spoken, "above").groupBy("_dir").agg(F.min(F.struct("up", "above", "told")).alias("b"))
    heirs = nearest.select(F.col("_dir").alias("_for"), F.col("b.told").alias("told"), F.col("b.above").alias("from"))
    joined = marked.join(heirs, F.col("own_license").isNull() & (F.col("_dir") == F.col("_for")), "left")
    return joined.select(key, path, "own_license", "score", F.coalesce("own_license", "told").alias("license"), F.col("from").alias("inherited_from"))
