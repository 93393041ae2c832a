"""License scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

A template of m five-word shingles is looked for in windows of L shingles, L the least power of two (4 or more) such that
windows a quarter of L apart hold every run of m shingles whole.  A text that contains the share CONTAINMENT of the
template in such a run then has a window whose Jaccard similarity to it is at least CONTAINMENT / (4 + ...), never below
a fifth; with BANDS bands of one minimum each, a window like that collides with probability 1 - 0.8^64, over 0.999999.

A window collides with a template in a band only if it holds the shingle that is the template's minimum there.  Texts and
windows without any such shingle have no collision in any band, so their minima are not computed; the result is the same.
Everything is DataFrame functions.

A template of fewer than five words has its whole word sequence as its one shingle.  It is looked for at every word, in
windows of that many words, so it needs no bands: it is there whole or not at all.

Defined results: a null text is empty; a text of fewer than five words has no five-word shingle and can match short
templates only; a template without words matches nothing, as an empty template table does; repeated rows get their own
results; an empty table gives no rows; further columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.shared import settled

WIDTH = 5
BANDS = 64
CONTAINMENT = 0.8
LEAST_WINDOW = 4
WORD = r"[\p{L}\p{N}]+"

#: Notices as their licenses word them.
NOTICES = (
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Released under the MIT License."),
    ("reserved", "All rights reserved."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                  "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("bsd-terms", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                  "provided that the following conditions are met"),
    ("apache-terms", "Unless required by applicable law or agreed to in writing, software distributed under the License "
                     "is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
)


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NOTICES), "license string, text string")


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` looks at it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def worded(text: Column) -> Column:
    """The lower-cased words of a text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def shingles(words: Column) -> Column:
    """Hashes of the runs of WIDTH words, in order."""
    starts = F.sequence(F.lit(1), F.size(words) - (WIDTH - 1))
    runs = F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, WIDTH), " ")))
    return F.when(F.size(words) >= WIDTH, runs).otherwise(F.array().cast("array<bigint>"))


def spoken(words: Column, sayings: list[str]) -> Column:
    """(said, start): where each of ``sayings``, words with a blank between, is among ``words``."""
    none = F.array().cast("array<struct<said:string,start:int>>")
    if not sayings:
        return none
    firsts = sorted({s.split(" ")[0] for s in sayings})

    def placed(size: int) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: F.get(words, i - 1).isin(firsts))
        found = F.transform(starts, lambda i: F.struct(
            F.array_join(F.slice(words, i, size), " ").alias("said"), (i - 1).alias("start")))
        return F.when(F.size(words) >= size, F.filter(found, lambda x: x["said"].isin(sayings))).otherwise(none)

    return F.flatten(F.array(*[placed(size) for size in sorted({len(s.split(" ")) for s in sayings})]))


def bands(window: Column) -> Column:
    """The minimum of the window's shingles under each of BANDS hashes."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.array_min(
        F.transform(window, lambda h: F.xxhash64(h, k))))


def prepared(notices: DataFrame) -> DataFrame:
    """(license, own, m, length, values): a template's distinct shingles, window length and band values."""
    own = notices.select("license", bound(worded(F.col("text")), lambda w: F.array_distinct(shingles(w))).alias("own"))
    own = own.where(F.size("own") > 0)
    m = F.size("own")
    length = F.greatest(F.lit(LEAST_WINDOW), F.pow(F.lit(2.0), F.ceil(F.log2((m - 1) / F.lit(0.75) + 1e-9)))).cast("int")
    return own.select("license", "own", m.alias("m"), F.when(m > 1, length).otherwise(LEAST_WINDOW).alias("length"),
                      bands(F.col("own")).alias("values"))


def short(notices: DataFrame) -> DataFrame:
    """(license, said): the word sequence of each template of fewer than WIDTH words."""
    words = notices.select("license", worded(F.col("text")).alias("w")).where(F.size("w").between(1, WIDTH - 1))
    return words.select("license", F.array_join("w", " ").alias("said")).distinct()


def matched(docs: DataFrame, notices: DataFrame | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, matches), one row per row of ``docs``(doc_id, text); matches are (license, containment, word) by license:
    the best containment of each template and the first word of the window where it is reached first."""
    spark = docs.sparkSession
    notices = templates(spark) if notices is None else notices
    known, brief = settled(prepared(notices)), settled(short(notices))
    minima = known.select("license", "own", F.posexplode("values").alias("band", "value")).select(
        F.explode(F.filter("own", lambda h: F.xxhash64(h, F.col("band")) == F.col("value"))).alias("h")).distinct()
    # one number per template and band at most
    held = F.array(*[F.lit(r.h).cast("bigint") for r in minima.collect()]) if not minima.isEmpty() else None
    sayings = sorted({r.said for r in brief.select("said").collect()})  # one per short template at most
    rows = docs.select("doc_id", bound(worded(F.col("text")), lambda w: F.struct(
        shingles(w).alias("h"), spoken(w, sayings).alias("said"))).alias("found")).select("doc_id", "found.*")
    can = F.lit(False) if held is None else F.arrays_overlap("h", held)
    rows = settled(rows.withColumn("h", F.when(can, F.col("h"))).withColumn("row", F.monotonically_increasing_id()))

    lengths = sorted(r.length for r in known.select("length").distinct().collect())
    windows = F.flatten(F.array(*[
        F.transform(F.sequence(F.lit(0), F.size("h") - 1, F.lit(max(1, length // 4))), _window(length))
        for length in lengths])) if lengths else F.array().cast("array<struct<start:int,length:int,window:array<bigint>>>")
    cut = rows.where("h IS NOT NULL").select("row", F.explode(windows).alias("w")).select("row", "w.*")
    cut = cut if held is None else cut.where(F.arrays_overlap("window", held))
    found = cut.select("row", "start", "length", "window", F.posexplode(bands(F.col("window"))).alias("band", "value"))
    asked = known.select("license", "own", "m", "length", F.posexplode("values").alias("band", "value"))
    share = F.size(F.array_intersect("own", "window")) / F.col("m")
    hits = found.join(asked, ["band", "value", "length"]).select(
        "row", "license", "start", share.alias("containment")).where(F.col("containment") >= containment)
    whole = rows.where(F.size("said") > 0).select("row", F.explode("said").alias("s")).select("row", "s.*")
    hits = hits.union(whole.join(brief, "said").select("row", "license", "start", F.lit(1.0).alias("containment")))
    best = hits.groupBy("row", "license").agg(F.max(F.struct("containment", (-F.col("start")).alias("at"))).alias("b"))
    each = settled(best.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(
        "license", F.col("b.containment").alias("containment"), (-F.col("b.at")).alias("word")))).alias("matches")))
    return rows.drop("h", "said").join(each, "row", "left").select("doc_id", F.coalesce("matches", F.array().cast(
        "array<struct<license:string,containment:double,word:int>>")).alias("matches"))


def _window(length: int):
    def cut(start: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), F.lit(length).alias("length"),
                        F.slice(F.col("h"), start + 1, F.lit(length)).alias("window"))
    return cut
