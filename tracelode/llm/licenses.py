"""Licence texts in documents by diagonal voting.

Every rolling gram of GRAM words of every document is joined by its hash to the places where licence templates hold it, in
Spark. A hit votes for the diagonal (place in the document less place in the template) on which the whole template would
stand. Phrases, a few words long, need every one of their grams on one diagonal. Notices, a paragraph long, may differ by
words put in or left out, which moves the rest to a diagonal nearby: diagonals are merged by two overlapping grids of bins,
and a notice is found where enough of its grams, each counted once, meet in a bin. Hits are verified word by word against
their template before they vote, so spans rest on words, not on hashes.

Texts are cut into runs of words (RUN at most, overlapping by a gram), so that no row is larger than a run; only hits and a
row for each document are written. Grams of a notice that consist of function words alone don't vote.

Cases: a null text counts as empty; texts without words have no labels and null places; rows are told apart by doc_id and
text, so rows that repeat both have the same result, once for each; null ids are kept; other columns are left behind; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialise
from .textnum import slices

GRAM = 2
RUN, BATCH_CHARS = 1 << 13, 1 << 22
#: Width of a bin of diagonals; words put in or left out of a notice may move it by half of that.
BIN = 32
#: Share of a notice's voting grams that must be found.
LEAST = 0.5
#: More template grams than this are joined by a shuffle instead of a broadcast.
MOST_BROADCAST = 100_000


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    whole: bool = True  # every gram on one diagonal; else LEAST of them on diagonals nearby
    base: bool = False


# Phrases and their labels, and the first paragraphs of common licences, lower-cased, as words.
TEMPLATES = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
    Template("agpl", "gnu affero general public license"),
    Template("lgpl", "gnu lesser general public license"),
    Template("mpl", "mozilla public license"),
    Template("bsd", "bsd license"),
    Template("isc", "isc license"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc0", "cc0 1 0"),
    Template("creative-commons", "creative commons attribution"),
    Template("all-rights-reserved", "all rights reserved"),
    Template("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", whole=False),
    Template("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", whole=False),
    Template("apache-notice", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", whole=False),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", whole=False),
    Template("isc-notice", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", whole=False),
    Template("mpl-notice", "this source code form is subject to the terms of the mozilla public license", whole=False),
)
FUNCTION_WORDS = frozenset("a an and any are as at be by for from if in is it may not of on or that the this to was with without you".split())

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def template_grams(templates: tuple[Template, ...] = TEMPLATES) -> list[tuple[int, int, tuple[str, ...]]]:
    """(template, place, words) of the grams that vote."""
    out = []
    for k, t in enumerate(templates):
        words = t.text.split()
        grams = [(k, i, tuple(words[i : i + GRAM])) for i in range(len(words) - GRAM + 1)]
        out += [g for g in grams if t.whole or not FUNCTION_WORDS.issuperset(g[2])]
    return out


def runs_of_words(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_words, base and words: for each row one without words (null), and one for each run of words, which begins at word `base`."""
    names = ["doc_id", "key", "n_words", "base", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, every = batch.column("doc_id").cast(pa.int64()).to_pylist(), batch.column("text").to_pylist()
            for a, b in slices([len(t) for t in every], BATCH_CHARS):
                parts = [t.encode("utf-8") for t in every[a:b]]
                own = pa.array(ids[a:b], pa.int64())
                key = pa.array([hashlib.blake2b(p, digest_size=16, key=str(i).encode()).digest() for i, p in zip(ids[a:b], parts, strict=True)], pa.binary())
                low = _LOW[np.frombuffer(b"\n".join([*parts, b""]), np.uint8)]
                is_word = _WORD[low]
                edge = np.flatnonzero(np.diff(is_word, prepend=False, append=False))
                bounds = np.searchsorted(edge[0::2], np.cumsum([0, *(len(p) + 1 for p in parts)]))
                size = edge[1::2] - edge[0::2]
                letters = low[is_word]
                words = pa.StringArray.from_buffers(len(size), pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(letters))
                n_words = np.diff(bounds)
                yield pa.RecordBatch.from_arrays([own, key, pa.array(n_words), pa.nulls(b - a, pa.int64()), pa.nulls(b - a, pa.list_(pa.string()))], names)
                for i in range(0, int(n_words.max(initial=0)), RUN):  # texts of one run all go in the first turn
                    of = np.flatnonzero(n_words > i)
                    first = bounds[of] + i
                    last = np.minimum(first + RUN + GRAM - 1, bounds[of + 1])
                    at = np.concatenate([[0], np.cumsum(last - first)])
                    take = np.arange(at[-1]) - np.repeat(at[:-1], last - first) + np.repeat(first, last - first)
                    held = pa.ListArray.from_arrays(pa.array(at, pa.int32()), words.take(pa.array(take)))
                    yield pa.RecordBatch.from_arrays([own.take(pa.array(of)), key.take(pa.array(of)), pa.array(n_words[of]), pa.array(np.full(len(of), i, np.int64)), held], names)

    return documents(docs).mapInArrow(run, "doc_id long, key binary, n_words long, base long, words array<string>")


def _grams_table(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    rows = [(k, i, list(w)) for k, i, w in template_grams(templates)]
    return spark.createDataFrame(rows, "template int, place int, expected array<string>").coalesce(1)


def hits(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, key, n_words, at, template and place: a row for each document (template null), and one for each gram of it at each place of a template that holds the same words. Written once."""
    spark = docs.sparkSession
    known = _grams_table(spark, templates)
    hashed = known.select("template", "place", F.xxhash64(*[F.get("expected", F.lit(j)) for j in range(GRAM)]).alias("hash"))
    small = sum(len(t.text.split()) for t in templates) <= MOST_BROADCAST
    long = runs_of_words(docs).select("doc_id", "key", "n_words", "base", "words", F.posexplode_outer("words").alias("i", "w0"))
    more = {f"w{j}": F.get("words", F.col("i") + j) for j in range(1, GRAM)}
    words = [f"w{j}" for j in range(GRAM)]
    # The last words of a run have no gram of their own; the next run begins with them.
    gram = long.withColumns(more).select("doc_id", "key", "n_words", "i", (F.col("base") + F.col("i")).alias("at"), *words, F.when(F.col(words[-1]).isNotNull(), F.xxhash64(*words)).alias("hash"))
    met = gram.join(F.broadcast(hashed) if small else hashed, "hash", "left").where("i is null or template is not null")
    found = materialise(met.select("doc_id", "key", "n_words", "at", "template", "place", F.when(F.col("template").isNotNull(), F.array(*words)).alias("words")), "grams")
    told = found.join(F.broadcast(known) if small else known, ["template", "place"], "left")
    return told.where("template is null or words = expected").select("doc_id", "key", "n_words", "at", "template", "place")


def places(found: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, key, template, label, base, first and last (words), share: where templates stand, from hits."""
    spark = found.sparkSession
    votes = [0] * len(templates)
    for k, _, _ in template_grams(templates):
        votes[k] += 1
    told = F.broadcast(spark.createDataFrame([(k, t.label, t.whole, t.base, n, len(t.text.split())) for k, (t, n) in enumerate(zip(templates, votes, strict=True))], "template int, label string, whole boolean, base boolean, n_grams int, length int"))  # a row a template
    # Rows that repeat id and text vote once.
    by_place = found.where("template is not null").select("doc_id", "key", "template", "place", "at").distinct().withColumn("diagonal", F.col("at") - F.col("place"))
    lines = by_place.groupBy("doc_id", "key", "template", "diagonal").agg(F.collect_set("place").alias("seen"), F.min("at").alias("low"), F.max("at").alias("high")).join(told, "template")
    whole = lines.where("whole and size(seen) = n_grams").select("doc_id", "key", "template", "label", "base", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("length") - 1).alias("last"), F.lit(1.0).alias("share"))
    bins = F.explode(F.array(*(F.struct(F.lit(g).alias("grid"), F.floor((F.col("diagonal") + g * BIN // 2) / BIN).alias("bin")) for g in (0, 1))))
    merged = lines.where("not whole").withColumn("b", bins).groupBy("doc_id", "key", "template", "label", "base", "n_grams", "b").agg(F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("n"), F.min("low").alias("first"), (F.max("high") + GRAM - 1).alias("last"))
    near = merged.withColumn("share", F.col("n") / F.col("n_grams")).where(F.col("share") >= LEAST)
    # A notice in both grids is told once, by its fuller bin.
    near = near.groupBy("doc_id", "key", "template", "label", "base", "first").agg(F.max(F.struct("share", "last")).alias("x")).select("doc_id", "key", "template", "label", "base", "first", "x.last", "x.share")
    return whole.unionByName(near)


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score (the greatest share of a template found; 0 for none) of every document."""
    found = hits(docs, templates)
    rows = found.where("template is null").select("doc_id", "key", "n_words")
    own = F.col("base")
    by_doc = places(found, templates).groupBy("key").agg(
        F.count_if(own).alias("n_base"), F.min(F.when(own, F.col("first"))).alias("first_word"), F.max(F.when(own, F.col("first"))).alias("last_word"),
        F.array_sort(F.collect_set(F.when(own, F.col("label")))).alias("base_labels"), F.array_sort(F.collect_set("label")).alias("labels"), F.max("share").alias("score"),
    )
    named = lambda c: F.coalesce(F.array_join(c, ","), F.lit("")).alias(c)
    return rows.join(by_doc, "key", "left").select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", named("base_labels"), named("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def _sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    text = lambda s: "'" + s + "'"
    grams = ", ".join(f"({k}, {i}, {', '.join(map(text, w))})" for k, i, w in template_grams(templates))
    told = ", ".join(f"({k}, {text(t.label)}, {t.whole}, {t.base}, {sum(g[0] == k for g in template_grams(templates))})" for k, t in enumerate(templates))
    words = ", ".join(f"w{j}" for j in range(GRAM))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH g(k, place, {words}) AS (VALUES {grams}), t(k, label, whole, base, n_grams) AS (VALUES {told}),
 d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
 x AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), p AS (SELECT doc_id, i - 1 AS pos, {', '.join(f'w[i + {j}] AS w{j}' for j in range(GRAM))} FROM x),
 h AS (SELECT DISTINCT doc_id, k, place, pos, pos - place AS diagonal FROM p JOIN g USING ({words})),
 l AS (SELECT doc_id, h.k, diagonal, count(*) AS n FROM h GROUP BY ALL),
 f AS (SELECT doc_id, label, base, diagonal AS first, 1.0 AS share FROM l JOIN t ON l.k = t.k WHERE whole AND n = n_grams UNION ALL
  SELECT doc_id, label, base, NULL, count(DISTINCT place) / n_grams FROM h JOIN t ON h.k = t.k, (VALUES (0), (1)) o(grid) WHERE NOT whole GROUP BY doc_id, label, base, n_grams, grid, floor((diagonal + grid * {BIN // 2}) / {BIN}) HAVING count(DISTINCT place) / n_grams >= {LEAST}),
 a AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM f GROUP BY doc_id)
 SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM d LEFT JOIN a ON d.doc_id = a.doc_id"""


#: DuckDB SQL for the query's rows, where ids are distinct.
SQL = _sql()
