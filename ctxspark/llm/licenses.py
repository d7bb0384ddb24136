"""License notices in texts: exact phrases, and an exact set-similarity join of text blocks with notice templates.

Everything is DataFrame operations; no Python runs on the executors."""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxspark.llm.common import cut

#: Phrases, in words, and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Wordings of common license notices, and their labels.
TEMPLATES = (
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may obtain a copy of the license at http www apache org licenses license 2 0", "apache-2"),
    ("this work is licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under cc by 4 0", "cc-by"),
    ("creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under cc by sa 4 0", "cc-by-sa"),
    ("creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("dedicated to the public domain under cc0 1 0 universal", "cc0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this work is licensed under the gnu general public license version 2", "gpl-2"),
    ("this work is licensed under the gnu lesser general public license version 3", "lgpl-3"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
#: Share of a template's distinct words that a block must hold.
CONTAINMENT = 0.85
#: Blocks of a text: so many words, so far apart, whatever lines they stand on. Longer blocks would take words of
#: neighbouring notices together.
BLOCK_WORDS, BLOCK_STEP = 24, 6

#: Words of a text in lower case: runs of ASCII letters and digits and of anything beyond ASCII.
WORD = r"[a-z0-9\x{80}-\x{10FFFF}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _lits(values) -> Column:
    return F.array(*map(F.lit, values))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _need(own: set[str], containment: float) -> int:
    return ceil(containment * len(own) - 1e-9)


def _places(words: Column, phrase: list[str]) -> Column:
    """Where the phrase's words stand consecutively."""
    starts = F.when(F.size(words) >= len(phrase), F.sequence(F.lit(0), F.size(words) - len(phrase))).otherwise(F.array().cast("array<int>"))

    def here(i: Column) -> Column:
        out = F.get(words, i) == phrase[0]
        for k, w in enumerate(phrase[1:], 1):
            out = out & (F.get(words, i + k) == w)
        return out

    return F.filter(starts, here)


def read_once(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """docs (id, text) to (row, id, n_words, seen, p0, p1, ..., words), a written table: the only reading of the texts.
    seen are the words of phrases and templates that stand in the text, p0... the places of each phrase, and words the
    whole text's, if it holds enough words of some template at all.

    Words are counted in the text as Unicode lowers it, which changes no boundary of a word and no ASCII word; what is
    compared in the end is folded from A-Z alone."""
    own = [set(t.split()) for t, _ in templates]
    split = [p.split() for p, _ in phrases]
    vocabulary = sorted(set().union(*own, *split))
    docs = docs.select("id", F.coalesce("text", F.lit("")).alias("text"))
    met = docs.select("id", "text", _words(F.lower("text")).alias("w"))
    met = met.select("id", "text", F.size("w").cast("long").alias("n_words"), F.array_intersect("w", _lits(vocabulary)).alias("seen"))
    phrase = _any([F.size(F.array_except(_lits(p), F.col("seen"))) == 0 for p in split])
    template = _any([(F.size("seen") >= _need(o, containment)) & (F.size(F.array_intersect(F.col("seen"), _lits(sorted(o)))) >= _need(o, containment)) for o in own])
    met = met.withColumn("phrase", phrase).withColumn("template", template)
    folded = _words(F.translate("text", _UPPER, _LOWER))
    met = met.select("id", "n_words", "seen", "phrase", "template", F.when(F.col("phrase") | F.col("template"), folded).alias("w"))
    none = F.array().cast("array<int>")
    places = [F.when(F.col("phrase"), _places(F.col("w"), p)).otherwise(none).alias(f"p{k}") for k, p in enumerate(split)]
    return cut(met.select(F.monotonically_increasing_id().alias("row"), "id", "n_words", "seen", *places, F.when(F.col("template"), F.col("w")).alias("words")))


def token_order(read: DataFrame, templates=TEMPLATES) -> list[str]:
    """The templates' distinct words from the rarest to the most frequent, by the texts that hold them."""
    counts = read.select(F.explode("seen").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    known = {r.word: r.n for r in counts.collect()}  # words of the fixed lists only
    return sorted({w for t, _ in templates for w in t.split()}, key=lambda w: (known.get(w, 0), w))


def template_matches(read: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """read (row, seen, words) to (row, block, label, share): the templates of which each block holds that share of the
    distinct words, but for those that another one of the block explains: all words they have in common with the block
    are among its words, and it has more of them, or a larger share. (So a notice of one version, or of a longer
    license name, is not taken for those that it differs from by a word.)

    Words are ordered by their frequency in all texts. A block that holds enough of a template shares a word with its
    prefix (its so many rarest words), so blocks meet templates on prefix words only (prefix filter), and a pair goes
    on only if the block's template words suffice at all (length filter) and from the shared word on (positional
    filter). The overlap is then counted exactly."""
    order = token_order(read, templates)
    rank = {w: k for k, w in enumerate(order)}
    rows = []
    for k, (t, label) in enumerate(templates):
        own = sorted(set(t.split()), key=rank.__getitem__)
        need = _need(set(own), containment)
        rows += [(w, k, label, i, len(own), need, own) for i, w in enumerate(own[: len(own) - need + 1])]
    prefixes = read.sparkSession.createDataFrame(rows, "word string, template int, label string, i int, n int, need int, own array<string>")
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - (BLOCK_WORDS - BLOCK_STEP) - 1, F.lit(0)), F.lit(BLOCK_STEP))
    blocks = read.where("words is not null").select("row", "words", F.explode(starts).alias("block"))
    blocks = blocks.select("row", "block", F.array_intersect(_lits(order), F.slice("words", F.col("block") + 1, BLOCK_WORDS)).alias("has"))
    pairs = blocks.select("row", "block", "has", F.posexplode("has").alias("j", "word")).join(F.broadcast(prefixes), "word")
    room = F.least(F.col("n") - F.col("i"), F.size("has") - F.col("j"))
    close = pairs.where((F.size("has") >= F.col("need")) & (room >= F.col("need")))
    close = close.select("row", "block", "template", "label", "n", "need", F.array_intersect("own", "has").alias("both")).where(F.size("both") >= F.col("need"))
    held = close.groupBy("row", "block").agg(F.collect_set(F.struct("template", "label", "both", (F.size("both") / F.col("n")).alias("share"))).alias("all"))

    def explained(x: Column) -> Column:
        within = lambda y: F.size(F.array_except(x["both"], y["both"])) == 0
        return F.exists("all", lambda y: (x["template"] != y["template"]) & within(y) & ((F.size(y["both"]) > F.size(x["both"])) | (y["share"] > x["share"])))

    one = held.select("row", "block", F.explode(F.filter("all", lambda x: ~explained(x))).alias("x"))
    return one.select("row", "block", F.col("x.label").alias("label"), F.col("x.share").alias("share"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score): phrases and templates of each row of
    docs. score is 1 with a phrase, else the largest share of a template found, else 0.

    Blocks run over the words of the whole text, so a notice of up to 19 words lies whole in one of them however it is
    wrapped. A null text is empty; rows that repeat an id, and rows with a null id, are told apart. Other columns are
    not read; an empty table gives an empty result. The template table is a fixed list and so may be broadcast; texts
    are never shuffled."""
    read = read_once(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    found = cut(template_matches(read).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share")))
    every = F.concat(*[F.col(f"p{k}") for k in range(len(PHRASES))])
    base = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)]))))
    told = read.select("row", "id", "n_words", every.alias("at"), base.alias("base")).join(found, "row", "left")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    score = F.when(F.size("at") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0)))
    ends = [F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word")]
    return told.select("id", "n_words", F.size("at").cast("long").alias("n_base"), *ends, F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
