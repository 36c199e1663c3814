"""License scans (operator 12), by DataFrame functions alone: phrases, and an exact set-similarity join with templates.

A short list of phrases is counted where its words stand consecutively. The method finds reworded and longer notices: a
text block whose set of words holds at least CONTAINMENT of a template's distinct words. Blocks are stretches of twice
`step` words that begin at every `step`-th word, so that any stretch of up to `step` words, as long as the longest
template of its class, lies whole in a block. The join orders tokens by their count in all documents, rarest first: a
block that holds enough of a template must share one of the template's first tokens (prefix filter), must have as many
tokens as are needed (length filter), and after the first shared token both must have enough tokens left (positional
filter); pairs that pass are verified exactly. Only template tokens are kept of a block, so its rows are of bounded size.

Equal texts are scanned once, under a digest of their words. What is broadcast is made of the templates alone: their
order, their prefixes and their tokens.

Defined results: a null or empty text has no words, no labels and score 0. The score is 1 where a phrase stands,
else the largest containment found. Rows keep their number and repeat if repeated; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, id_text, join_hot, stored

#: Percent of a template's distinct words that a block must hold.
CONTAINMENT = 80

#: (label, phrase). Fixed values of the contract.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]

#: (label, text). Opening sentences of public licenses and the notices that refer to them.
TEMPLATES = [
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
]

#: Steps of the classes of templates; a template is of the first that is not shorter than it.
STEPS = (24, 96)

#: Capital letters beyond ASCII whose lower case has ASCII letters; any other letter beyond ASCII does in their place.
_KELVIN, _DOTTED = "K", "İ"
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def body_of(text: Column) -> Column:
    """The words, A-Z in lower case, each after one blank but the first."""
    low = F.lower(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit(_KELVIN), F.lit("é")), F.lit(_DOTTED), F.lit("é")))
    return F.trim(F.regexp_replace(low, _SEPARATORS, " "))


def _blanks(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" ")))).cast("long")


def templates(spec=TEMPLATES, percent: int = CONTAINMENT) -> list[dict]:
    """Label, distinct tokens, step and the number of tokens that a block needs, of each template."""
    out = []
    for n, (label, text) in enumerate(spec):
        tokens = sorted(set(text.split()))
        step = next((s for s in STEPS if len(text.split()) <= s), len(text.split()))
        out.append({"template": n, "label": label, "tokens": tokens, "step": step, "need": -(-len(tokens) * percent // 100)})
    return out


def order_of(bodies: DataFrame, spec: list[dict]) -> list[str]:
    """The templates' tokens, rarest first, by the number of texts of the whole table that hold them."""
    every = sorted({t for s in spec for t in s["tokens"]})
    held = F.array_intersect(F.split("body", " "), F.array(*map(F.lit, every)))
    counted = {r["token"]: r["n"] for r in bodies.select(F.explode(held).alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}
    return sorted(every, key=lambda t: (counted.get(t, 0), t))


def _phrases(body: Column, n_words: Column, phrases) -> tuple[Column, Column, Column, Column]:
    """(places, first start, last start, labels) of the phrases."""
    padded = F.concat(F.lit(" "), body, F.lit(" "))
    count, first, last, labels = [], [], [], []
    for label, phrase in phrases:
        there = padded.contains(f" {phrase} ")
        count.append(F.when(there, F.regexp_count(padded, F.lit(f"(?<= ){phrase}(?= )")).cast("long")).otherwise(0))
        first.append(F.when(there, _blanks(F.substring_index(padded, f" {phrase} ", 1))))
        last.append(F.when(there, n_words - _blanks(F.substring_index(padded, f" {phrase} ", -1)) - len(phrase.split())))
        labels.append(F.when(there, F.lit(label)))
    many = lambda f, c: f(*c) if len(c) > 1 else c[0]
    return sum(count[1:], count[0]), many(F.least, first), many(F.greatest, last), F.array_sort(F.array_distinct(F.array_compact(F.array(*labels))))


def marked(docs: DataFrame, order: list[str], spec: list[dict], phrases=PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, what the phrases give, and of texts that hold a token of a template's prefix their words and a digest."""
    rank = {t: k for k, t in enumerate(order)}
    prefix = sorted({t for s in spec for t in sorted(s["tokens"], key=rank.get)[: len(s["tokens"]) - s["need"] + 1]})
    rows = id_text(docs, id_col, text_col).select("doc_id", body_of(F.col("text")).alias("body"))
    rows = rows.withColumn("n_words", F.when(F.col("body") == "", F.lit(0).cast("long")).otherwise(_blanks(F.col("body")) + 1))
    n_base, first, last, labels = _phrases(F.col("body"), F.col("n_words"), phrases)
    rows = rows.select("*", n_base.alias("n_base"), first.alias("first_word"), last.alias("last_word"), labels.alias("base"))
    held = F.arrays_overlap(F.split("body", " "), F.array(*map(F.lit, prefix)))
    return rows.withColumn("body", F.when(held, F.col("body"))).withColumn("digest", F.md5("body"))


def _blocks(texts: DataFrame, order: list[str], spec: list[dict]) -> DataFrame:
    """digest, step, start, tokens: the ranks of the template tokens in each block, ascending."""
    spark = texts.sparkSession
    ranks = spark.createDataFrame(list(enumerate(order)), "rank int, token string")
    steps = sorted({s["step"] for s in spec})
    placed = texts.select("digest", F.posexplode(F.split("body", " ")).alias("at", "token")).join(F.broadcast(ranks), "token")
    both = F.explode(F.array(*[F.struct(F.lit(s).alias("step"), ((F.floor(F.col("at") / s) - back) * s).cast("int").alias("start")) for s in steps for back in (0, 1)])).alias("b")
    return placed.select("digest", "rank", both).where("b.start >= 0").groupBy("digest", "b.step", "b.start").agg(F.array_sort(F.collect_set("rank")).alias("tokens"))


def matches(texts: DataFrame, order: list[str], spec: list[dict]) -> DataFrame:
    """digest, start, words, label, containment: all blocks of (digest, body) that hold enough of a template."""
    spark = texts.sparkSession
    rank = {t: k for k, t in enumerate(order)}
    ranked = [s | {"ranks": sorted(rank[t] for t in s["tokens"])} for s in spec]
    prefixes = [(s["step"], r, s["template"], place, len(s["ranks"]), s["need"]) for s in ranked for place, r in enumerate(s["ranks"][: len(s["ranks"]) - s["need"] + 1])]
    index = spark.createDataFrame(prefixes, "step int, rank int, template int, place int, n int, need int")
    whole = spark.createDataFrame([(s["template"], s["label"], s["ranks"]) for s in ranked], "template int, label string, wanted array<int>")
    blocks = _blocks(texts, order, spec).where(F.size("tokens") >= min(s["need"] for s in spec))
    probes = blocks.select("digest", "step", "start", "tokens", F.posexplode("tokens").alias("at", "rank"))
    shared = probes.join(F.broadcast(index), ["step", "rank"]).where(F.size("tokens") >= F.col("need"))
    # of the tokens that a pair shares, the first one bounds how many can follow
    left = F.least(F.col("first.n") - F.col("first.place"), F.size("tokens") - F.col("first.at"))
    pairs = shared.groupBy("digest", "step", "start", "template", "tokens").agg(F.min(F.struct("place", "at", "n", "need")).alias("first")).where(left >= F.col("first.need"))
    overlap = F.size(F.array_intersect("wanted", "tokens"))
    verified = pairs.join(F.broadcast(whole), "template").where(overlap >= F.col("first.need"))
    return verified.select("digest", "start", (F.col("step") * 2).alias("words"), "label", (overlap / F.size("wanted")).alias("containment"))


def scan(docs: DataFrame, spec=TEMPLATES, percent: int = CONTAINMENT, phrases=PHRASES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, blocks). Documents: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, digest.
    Blocks: what `matches` finds, by the digest of the text's words."""
    spec = templates(spec, percent)
    order = order_of(id_text(docs, id_col, text_col).select(body_of(F.col("text")).alias("body")), spec)
    rows = stored(marked(docs, order, spec, phrases, id_col, text_col))
    some = rows.where("digest is not null")
    blocks = stored(matches(some.select("digest", "body").dropDuplicates(["digest"]), order, spec))
    found = blocks.groupBy("digest").agg(F.collect_set("label").alias("found"), F.max("containment").alias("containment"))
    copies = stored(some.groupBy("digest").agg(F.count("*").alias("n")))
    light = rows.drop("body")
    joined = join_hot(light.where("digest is not null"), found, ["digest"], hot_keys(copies, ["digest"]), "left")
    every = joined.unionByName(light.where("digest is null").select("*", F.lit(None).cast("array<string>").alias("found"), F.lit(None).cast("double").alias("containment")))
    both = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("found", F.array().cast("array<string>")))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0)))
    out = every.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base").alias("base_labels"), F.concat_ws(",", both).alias("labels"), score.alias("score"), "digest")
    return out, blocks


def sql(spec=TEMPLATES, percent: int = CONTAINMENT, phrases=PHRASES) -> str:
    """The same documents by DuckDB: every block is counted against every template."""
    text = lambda t: "'" + t + "'"
    wanted = ", ".join(f"({s['template']}, '{s['label']}', {text(t)}, {s['step']}, {s['need']}, {len(s['tokens'])})" for s in templates(spec, percent) for t in s["tokens"])
    says = lambda p: " AND ".join(f"w{k} = '{w}'" for k, w in enumerate(p.split()))
    most = max(len(p.split()) for _, p in phrases)
    leads = ", ".join(f"lead(w, {k}) OVER (PARTITION BY rid ORDER BY i) AS w{k}" for k in range(1, most))
    places = " UNION ALL ".join(f"SELECT rid, i, '{label}' AS label FROM led WHERE {says(p)}" for label, p in phrases)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), w AS (SELECT rid, unnest(words) AS w, unnest(range(len(words))) AS i FROM d),
led AS (SELECT rid, i, w AS w0, {leads} FROM w),
base AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM ({places}) GROUP BY rid),
wanted(template, label, token, step, need, size) AS (VALUES {wanted}),
hits AS (SELECT rid, template, label, need, size, w, unnest([i // step, i // step - 1]) AS block FROM w JOIN wanted ON w = token),
found AS (SELECT rid, label, count(DISTINCT w) / size AS share FROM hits WHERE block >= 0 GROUP BY rid, template, label, need, size, block HAVING count(DISTINCT w) >= need),
more AS (SELECT rid, list(DISTINCT label) AS labels, max(share) AS share FROM found GROUP BY rid)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(base.labels, ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN more USING (rid)
"""


SQL = sql()
