"""License scans: an exact set-similarity join of text blocks with license templates.

A template is a set of words; a block contains it to the share of its words that the
block has. Templates of up to ``s`` words (``s`` a power of two) meet blocks of ``2 * s`` words
that begin at every multiple of ``s``, so any run of ``s`` words lies whole in a block. Every
block that holds ``threshold`` of a template's words is found:

1. Each text is read once: its words, the places of the base phrases, the documents that
   have each template word (the global frequencies), and of each block the words that any template
   of its size has. Blocks with fewer of them than the least template needs are
   left out (length filter).
2. The words of blocks and templates are put in one order, rarest first. A block and a
   template that share ``need`` words share one of the first ``n - need + 1`` of either
   (prefix filter), so the join is an equality join on the words of these prefixes.
3. A pair stays if the words after the shared one can still make up ``need`` (position
   filter), if that word is the first that both have (so a pair is met once), and if the sets,
   compared in full, share ``need`` words.

The templates are a parameter written out by the caller and so bound the vocabulary, the
frequencies and the prefix table, which alone is broadcast; blocks are never shuffled.

Defined results: a null or empty text has no words and no labels. Texts are read whole,
however long. Repeated rows each get a row. A null doc_id is kept. An empty table gives an empty
result. Columns other than id and text are ignored. Of equally contained templates each
gives its label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import column, small_batches, staged, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORDS = re.compile(WORD.encode())
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
THRESHOLD = 0.8
#: Words of the smallest blocks' templates.
LEAST = 8

# Public notices by which works are put under a license, and their labels.
TEMPLATES = (
    ("mit", "Released under the MIT license"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software"
        " without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation,"
        " either version 3 of the License, or (at your option) any later version",
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A to Z) words in UTF-8."""
    return WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower())


@dataclass(frozen=True)
class Template:
    label: str
    words: frozenset[bytes]
    size: int
    need: int


@dataclass(frozen=True)
class Scan:
    """Templates and phrases with the numbers of their words."""

    templates: tuple[Template, ...]
    phrases: tuple[tuple[str, tuple[bytes, ...]], ...]

    @classmethod
    def of(cls, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> Scan:
        made = []
        for label, text in templates:
            words = words_of(text)
            if not words:
                raise ValueError(f"a template of {label!r} has no words")
            distinct = frozenset(words)
            made.append(Template(label, distinct, max(LEAST, 1 << (len(words) - 1).bit_length()), needed(len(distinct), threshold)))
        return cls(tuple(made), tuple((label, tuple(words_of(phrase))) for phrase, label in phrases.items()))

    @cached_property
    def numbers(self) -> dict[bytes, int]:
        used = {w for t in self.templates for w in t.words} | {w for _, p in self.phrases for w in p}
        return {w: i for i, w in enumerate(sorted(used))}

    @cached_property
    def least(self) -> dict[int, int]:
        """Block size -> the words that a block must have to hold any of its templates."""
        return {s: min(t.need for t in self.templates if t.size == s) for s in sorted({t.size for t in self.templates})}

    @cached_property
    def of_size(self) -> dict[int, np.ndarray]:
        """Block size -> whether a word (the last entry: any other) is in a template of this size."""
        out = {}
        for size in self.least:
            out[size] = np.zeros(len(self.numbers) + 1, bool)
            out[size][[self.numbers[w] for t in self.templates if t.size == size for w in t.words]] = True
        return out

    def blocks(self, numbers: np.ndarray) -> Iterator[dict]:
        """The blocks of a text of these word numbers (-1: no template's word) that pass the length filter."""
        for size, least in self.least.items():
            at = np.flatnonzero(self.of_size[size][numbers])
            if len(at) < least:
                continue
            half = np.bincount(at // size, minlength=len(numbers) // size + 2)
            for k in np.flatnonzero(half[:-1] + half[1:] >= least).tolist():
                first, last = np.searchsorted(at, (k * size, (k + 2) * size))
                if k * size < len(numbers) and len(tokens := np.unique(numbers[at[first:last]])) >= least:
                    yield {"size": size, "start": k * size, "tokens": tokens.tolist()}

    def places(self, numbers: np.ndarray) -> dict[tuple[bytes, ...], np.ndarray]:
        """Where each phrase stands."""
        out = {}
        for _, phrase in self.phrases:
            n = max(len(numbers) - len(phrase) + 1, 0)
            stands = np.ones(n, bool)
            for i, word in enumerate(phrase):
                stands &= numbers[i : i + n] == self.numbers[word]
            out[phrase] = np.flatnonzero(stands)
        return out


def needed(n: int, threshold: float) -> int:
    """Shared words of ``n`` that make up the threshold."""
    return max(1, int(np.ceil(threshold * n - 1e-9)))


def scanned(docs: DataFrame, scan: Scan, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: ``row`` (its number), doc_id, n_words, places of the base phrases, their labels, its blocks. Every task adds one
    without a ``row``, whose ``documents`` counts the documents that have each word of the scan."""
    small_batches(docs.sparkSession)
    long, labels = T.LongType(), T.ArrayType(T.StringType())
    blocks = T.ArrayType(T.StructType([T.StructField("size", long), T.StructField("start", long), T.StructField("tokens", T.ArrayType(long))]))
    names = ("n_words", "n_base", "first_word", "last_word")
    schema = T.StructType(
        [T.StructField("row", long), T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(n, long) for n in names), T.StructField("base", labels), T.StructField("blocks", blocks), T.StructField("documents", T.ArrayType(long))]
    )
    arrow_blocks = pa.list_(pa.struct([("size", pa.int64()), ("start", pa.int64()), ("tokens", pa.list_(pa.int64()))]))
    types = [*(pa.int64() for _ in names), pa.list_(pa.string()), arrow_blocks, pa.list_(pa.int64())]

    def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = scan.numbers.get
        documents = np.zeros(len(scan.numbers) + 1, np.int64)
        id_type = pa.int64()
        for batch in batches:
            rows = []
            for text in batch.column(2).to_pylist():
                words = words_of(text)
                numbers = np.fromiter((number(w, -1) for w in words), np.int64, len(words))
                documents[np.unique(numbers)] += 1
                places = scan.places(numbers)
                found = np.concatenate(list(places.values())) if places else numbers[:0]
                base = sorted({label for label, phrase in scan.phrases if len(places[phrase])})
                ends = (int(found.min()), int(found.max())) if len(found) else (None, None)
                rows.append((len(words), len(found), *ends, base, list(scan.blocks(numbers)), None))
            id_type = batch.column(1).type
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=schema.names)
        summary = [pa.nulls(1, pa.int64()), pa.nulls(1, id_type), *(pa.nulls(1, kind) for kind in types[:-1]), pa.array([documents[:-1].tolist()], types[-1])]
        yield pa.RecordBatch.from_arrays(summary, names=schema.names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), column(id_col).alias("doc_id"), column(text_col).alias("text"))
    return rows.mapInArrow(scan_batches, schema)


def ranks(rows: DataFrame, scan: Scan) -> list[int]:
    """The place of every word of the scan in the order by documents that have it, rarest first."""
    counted = rows.filter(F.col("row").isNull()).select(F.posexplode("documents").alias("word", "n")).groupBy("word").agg(F.sum("n").alias("n"))
    n = {r["word"]: r["n"] for r in counted.collect()}  # as many rows as the templates have words
    order = sorted(range(len(scan.numbers)), key=lambda i: (n.get(i, 0), i))
    return np.argsort(order).tolist()


def contained(rows: DataFrame, scan: Scan) -> DataFrame:
    """(row, template, label, size, start, shared, containment) of every block of ``rows`` (as ``scanned`` gives) and template that it contains."""
    place = ranks(rows, scan)
    prefixes = []
    for i, t in enumerate(scan.templates):
        tokens = sorted(place[scan.numbers[w]] for w in t.words)
        prefixes += [(i, t.label, t.size, len(tokens), t.need, tokens, token, at) for at, token in enumerate(tokens[: len(tokens) - t.need + 1])]
    schema = "template long, label string, size long, t_n int, need int, t_tokens array<long>, token long, t_at int"
    prefixes = rows.sparkSession.createDataFrame(prefixes, schema)
    least = F.create_map(*(F.lit(x).cast("long") for pair in scan.least.items() for x in pair))
    order = F.array(*(F.lit(p).cast("long") for p in place))
    blocks = rows.filter(F.size("blocks") > 0).select("row", F.inline("blocks")).withColumn("tokens", F.array_sort(F.transform("tokens", lambda t: F.get(order, t.cast("int")))))
    begins = F.slice("tokens", 1, (F.size("tokens") - least[F.col("size")] + 1).cast("int"))
    met = blocks.select("row", "size", "start", "tokens", F.posexplode(begins).alias("at", "token")).join(F.broadcast(prefixes), ["size", "token"])
    able = F.least(F.col("t_n") - F.col("t_at"), F.size("tokens") - F.col("at")) >= F.col("need")
    both = met.filter(able).withColumn("both", F.array_intersect("tokens", "t_tokens"))
    kept = both.filter((F.get("both", F.lit(0)) == F.col("token")) & (F.size("both") >= F.col("need")))
    return kept.select("row", "template", "label", "size", "start", F.size("both").alias("shared"), (F.size("both") / F.col("t_n")).alias("containment"))


def scan_documents(docs: DataFrame, scan: Scan | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_words, places of the base phrases, base_labels, labels (the templates' too) and score: 1 with a base phrase, else the
    largest containment that reaches the threshold, else 0."""
    scan = scan or Scan.of()
    rows = staged(scanned(docs, scan, id_col, text_col), "license-blocks")
    found = contained(rows, scan).groupBy("row").agg(F.collect_set("label").alias("found"), F.max("containment").alias("containment"))
    joined = rows.filter(F.col("row").isNotNull()).drop("blocks", "documents").join(found, "row", "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base").alias("base_labels"), F.concat_ws(",", labels).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )


def op12_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))


def oracle(scan: Scan, source: str = "documents") -> str:
    """The same by brute force: every block against every template of its size, every place against every phrase."""

    def listed(words) -> str:
        return "[" + ", ".join(f"'{w.decode()}'" for w in words) + "]"

    templates = ", ".join(f"('{t.label}', {t.size}, {t.need}, {listed(sorted(t.words))})" for t in scan.templates)
    phrases = ", ".join(f"('{label}', {listed(phrase)})" for label, phrase in scan.phrases)
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words
  FROM {source}),
t(label, size, need, wanted) AS (VALUES {templates}),
p(label, phrase) AS (VALUES {phrases}),
starts AS (SELECT DISTINCT row, size, unnest(range(0, len(words), size)) AS start FROM d, (SELECT DISTINCT size FROM t)),
shared AS (
  SELECT row, label, need, len(wanted) AS n, len(list_intersect(words[start + 1 : start + 2 * size], wanted)) AS common
  FROM starts JOIN d USING (row) JOIN t USING (size)),
found AS (SELECT row, list(DISTINCT label) AS labels, max(common / n) AS containment FROM shared WHERE common >= need GROUP BY row),
places AS (
  SELECT row, label, unnest(list_filter(range(0, len(words)), lambda i: words[i + 1 : i + len(phrase)] = phrase)) AS place FROM d, p),
base AS (SELECT row, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY row)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(base.labels, found.labels))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(containment, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (row) LEFT JOIN found USING (row)"""


QUERIES = {"op12_license_join": op12_license_join}
ORACLES = {"op12_license_join": oracle(Scan.of())}
