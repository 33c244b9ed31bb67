"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import materialize

#: Phrases and labels of the base scan.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices, their labels, and the words that a block can't lack whatever else is missing.
TEMPLATES = (
    ("released under the mit license", "mit", "mit"),
    ("licensed under the apache license version 2 0", "apache-2", "apache 2"),
    ("licensed under cc by nc 4 0", "cc-by-nc", "cc nc"),
    ("licensed under the gnu general public license", "gpl", "gnu"),
    ("subject to the terms of the mozilla public license", "mpl", "mozilla"),
    ("all rights reserved", "all-rights-reserved", ""),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "mit",
        "charge sublicense",
    ),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd", "redistribution binary"),
    (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission",
        "bsd-3",
        "endorse",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies",
        "isc",
        "fee",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy "
        "of the license at http www apache org licenses license 2 0",
        "apache-2",
        "apache 2",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
        "free software foundation either version 3 of the license or at your option any later version",
        "gpl",
        "gnu",
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you "
        "can obtain one at http mozilla org mpl 2 0",
        "mpl",
        "mozilla",
    ),
)
#: Share of a template's distinct words that a block must hold, and the least step from block to block.
THRESHOLD, STEP = 0.8, 16
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain(text: str) -> Column:
    """Lower case (A-Z), every run of ASCII characters that are no letter or digit a single blank; null: empty."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), upper, upper.lower())
    return F.trim(F.regexp_replace(lowered, SEPARATORS, " "))


def words_of(line: str) -> Column:
    return F.when(F.col(line) == "", F.array().cast("array<string>")).otherwise(F.split(line, " "))


def block_step(notice: str) -> int:
    """Words from one block to the next for a template: a power of two that its words don't exceed, so that each
    passage as long as the template lies whole in one block of twice the step."""
    return max(STEP, 1 << (len(notice.split()) - 1).bit_length())


def text_key(text_col: str) -> Column:
    """MD5 of the text as 16 bytes: labels depend on texts alone, so ids may be null or repeated."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def template_blocks(docs: DataFrame, templates: Sequence[tuple[str, str, str]] = TEMPLATES, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``tid, step, block, template, label, containment`` for each distinct text (``tid``: :func:`text_key`): every block
    that holds at least ``threshold`` of a template's distinct words, and all words that the template can't lack.
    Block b of a step is the words from b * step to b * step + 2 * step, and a template's step follows its length
    (:func:`block_step`), so any passage of its length lies in one block whole; no block is skipped and no text cut.

    Words of templates are put in one global order, rarest in the corpus first. A block can only reach the overlap
    a = ceil(threshold * t) with a template of t words if one of the template's first t - a + 1 words is among the
    block's first n - a + 1 (prefix filter), n >= a (length filter), and enough words are left after the first common
    one on both sides (positional filter). Documents without any prefix word end in the scan; the other ones' blocks
    meet templates through an equi-join on prefix words, and overlaps are counted for those candidates only.
    Broadcast are tables of the templates' words, whose size is that of the parameter ``templates``. Null and empty
    texts have no block; without templates or documents the result is empty.
    """
    spark = docs.sparkSession
    rows = [(k, label, block_step(line), must.split(), w) for k, (line, label, must) in enumerate(templates) for w in dict.fromkeys(line.split())]
    vocabulary = sorted({r[-1] for r in rows})
    words = spark.createDataFrame(rows, "template int, label string, step int, must array<string>, word string")
    lines = docs.select(text_key(text_col).alias("tid"), plain(text_col).alias("line"))
    token = lines.select(F.explode(words_of("line")).alias("word")).where(F.col("word").isin(vocabulary))
    seen = materialize(token.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    # One row for each word of a template: there are as many as the parameter has.
    ranked = words.select("word").distinct().join(F.broadcast(seen), "word", "left")
    ranked = ranked.select(
        "word", F.coalesce("n", F.lit(0)).alias("n"),
        F.row_number().over(Window.orderBy(F.coalesce("n", F.lit(0)), "word")).alias("rank"),
    )
    ranked = materialize(ranked)
    need = F.ceil(F.col("t") * F.lit(threshold) - F.lit(1e-9)).cast("int")
    order = words.join(F.broadcast(ranked), "word")
    have = F.sort_array(F.collect_set(F.when(F.array_contains("must", F.col("word")), F.col("rank")))).alias("musts")
    sets = order.groupBy("template", "label", "step").agg(F.sort_array(F.collect_set("rank")).alias("ranks"), have)
    sets = sets.withColumn("t", F.size("ranks")).withColumn("need", need)
    prefix = materialize(sets.select("*", F.posexplode(F.slice("ranks", F.lit(1), F.col("t") - F.col("need") + 1)).alias("i", "rank")))
    rare = sorted(r[0] for r in prefix.select("rank").distinct().join(F.broadcast(ranked.where("n > 0")), "rank").select("word").collect())
    # From here on only documents with a rare word; there are no more of those than words in templates.
    some = lines.where(F.concat(F.lit(" "), "line", F.lit(" ")).rlike(f" (?:{'|'.join(rare) or '(?!)'}) "))
    at = some.select("tid", F.posexplode(words_of("line")).alias("pos", "word")).where(F.col("word").isin(vocabulary))
    at = at.join(F.broadcast(ranked.select("word", "rank")), "word")
    steps = F.explode(F.array(*[F.lit(x) for x in sorted({r[2] for r in rows})])) if rows else F.lit(STEP)
    at = at.select("tid", "rank", "pos", steps.alias("step")).withColumn("here", F.expr("cast(pos div step as long)"))
    at = at.select(
        "tid", "rank", "step",
        F.explode(F.when(F.col("here") > 0, F.array(F.col("here") - 1, "here")).otherwise(F.array("here"))).alias("block"),
    )
    blocks = at.groupBy("tid", "step", "block").agg(F.sort_array(F.collect_set("rank")).alias("held")).withColumn("n", F.size("held"))
    probe = blocks.select("*", F.posexplode("held").alias("j", "rank"))
    pairs = probe.join(F.broadcast(prefix), ["rank", "step"]).where((F.col("n") >= F.col("need")) & (F.col("j") <= F.col("n") - F.col("need")))
    # The first common word decides; later ones of the pair would only repeat it.
    first = F.min_by(F.struct("i", "j", "n", "t", "need", "label", "held", "ranks", "musts"), "j").alias("x")
    first = pairs.groupBy("tid", "step", "block", "template").agg(first).select("tid", "step", "block", "template", "x.*")
    first = first.where(F.least(F.col("t") - F.col("i"), F.col("n") - F.col("j")) >= F.col("need"))
    common = F.size(F.array_intersect("held", "ranks"))
    whole = F.size(F.array_intersect("held", "musts")) == F.size("musts")
    return first.where((common >= F.col("need")) & whole).select(
        "tid", "step", "block", "template", "label", (common / F.col("t")).alias("containment"),
    )


def phrase_places(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, tid, n_words, n_base, first_word, last_word, base_labels`` (an array) of every row: places where the
    words of a phrase stand consecutively, counted from word 0. Null and empty texts have no words."""
    lines = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("tid"), plain(text_col).alias("line"))
    padded = F.concat(F.lit(" "), F.col("line"), F.lit(" "))
    n = F.when(F.col("line") == "", F.lit(0)).otherwise(F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1).cast("long")

    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    found = lines.select("doc_id", "tid", "line", n.alias("n_words"))
    for k, phrase in enumerate(phrases):
        # Between the places of a phrase lie pieces of the line; every word of a piece has one blank before it.
        cut = F.when(padded.contains(f" {phrase} "), F.split(padded, f" {phrase}(?= )"))
        found = found.withColumn(f"cut{k}", cut)
    first, last, times = [], [], []
    for k, phrase in enumerate(phrases):
        cut = F.col(f"cut{k}")
        times.append(F.coalesce(F.size(cut) - 1, F.lit(0)))
        first.append(spaces(F.element_at(cut, 1)).cast("long"))
        last.append((F.col("n_words") - (spaces(F.element_at(cut, -1)) - 1) - len(phrase.split())).cast("long"))
    labels = F.array_compact(F.array(*[F.when(F.col(f"cut{k}").isNotNull(), F.lit(label)) for k, label in enumerate(phrases.values())]))
    lowest, highest = (first[0], last[0]) if len(phrases) == 1 else (F.least(*first), F.greatest(*last))
    return found.select(
        "doc_id", "tid", "n_words", sum(times[1:], times[0]).cast("long").alias("n_base"), lowest.alias("first_word"),
        highest.alias("last_word"), labels.alias("base_labels"),
    )


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: the base scan's columns, ``labels`` with those of the blocks, and ``score``, the
    largest containment (1 where a phrase stands, 0 without a label). Null and empty texts have no words and no labels;
    rows with null or repeated ids come out as they went in, each labelled by its own text; an empty table gives an empty
    result; other columns are ignored.

    Labels of blocks are found once for each distinct text and joined by its hash: few texts have any."""
    found = template_blocks(docs).groupBy("tid").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    joined = phrase_places(docs).join(materialize(found), "tid", "left")
    text = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    both = F.concat("base_labels", F.coalesce("more", F.array().cast("array<string>")))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", text("base_labels").alias("base_labels"),
        text(both).alias("labels"), score.alias("score"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and whole notices in every document."""
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    """Without any filter: all blocks, all templates, overlaps counted one by one."""
    templates = ", ".join(
        f"({k}, '{label}', '{w}', {len(set(line.split()))}, {block_step(line)}, {int(w in must.split())}, {len(set(must.split()))})"
        for k, (line, label, must) in enumerate(TEMPLATES)
        for w in dict.fromkeys(line.split())
    )
    hits = " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label, i FROM lists, range(0, n_words - {len(p.split()) - 1}) r(i) WHERE words[i + 1 : i + {len(p.split())}] = {p.split()}" for p, label in PHRASES.items())
    return rf"""
WITH lines AS (SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '{SEPARATORS}', ' ', 'g')) AS line FROM documents),
lists AS (SELECT doc_id, CASE WHEN line = '' THEN [] ELSE string_split(line, ' ') END AS words, len(words) AS n_words FROM lines),
hits AS ({hits}),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS ls FROM hits GROUP BY doc_id),
template(k, label, word, t, step, must, musts) AS (VALUES {templates}),
placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(0, n_words)) AS pos FROM lists),
met AS (SELECT doc_id, k, label, t, musts, must, word, unnest([pos // step - 1, pos // step]) AS b FROM placed JOIN template USING (word)),
overlap AS (SELECT doc_id, b, k, label, t, musts, count(DISTINCT word) AS common, count(DISTINCT word) FILTER (must = 1) AS got
            FROM met WHERE b >= 0 GROUP BY doc_id, b, k, label, t, musts),
more AS (SELECT doc_id, list(DISTINCT label) AS ls, max(common / t) AS best FROM overlap
         WHERE common >= ceil({THRESHOLD} * t - 1e-9) AND got = musts GROUP BY doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       array_to_string(list_sort(coalesce(base.ls, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(more.ls, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM lists LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
"""


OP5_SQL = _oracle()
