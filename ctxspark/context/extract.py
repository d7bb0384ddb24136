"""What a message says, as Columns of its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxspark.context import rules as R
from ctxspark.functions import text as X

ATOM = "key string, value string, type string, rule string, confidence string, start bigint, end bigint, snippet string"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _given(*items: tuple[Column, Column]) -> Column:
    """An array of the values whose test holds, in order."""
    return F.array_compact(F.array(*[F.when(test, value) for test, value in items]))


def _matches(low: Column, parts, words) -> Column:
    tests = ([X.contains_any(low, parts)] if parts else []) + ([X.contains_word(low, *words)] if words else [])
    return tests[0] if len(tests) == 1 else tests[0] | tests[1]


def access_labels(text: Column) -> Column:
    return let(X.lower(text), lambda low: _given((F.lit(True), F.lit(R.AGENT_INTERNAL)), (X.contains_any(low, R.CONFIDENTIAL_TERMS), F.lit(R.CONFIDENTIAL)), (X.contains_any(low, R.TOOL_TERMS), F.lit(R.TOOL_TRACE))))


def entities(text: Column) -> Column:
    return let(X.lower(text), lambda low: _given(*[(_matches(low, parts, words), F.lit(name)) for name, parts, words in R.ENTITIES]))


def tag_suggestions(text: Column) -> Column:
    """Array of (tag, score, reason) from the highest score down; the fallback if no rule matches."""

    def struct(tag: str, score: int, reason: str) -> Column:
        return F.struct(F.lit(tag).alias("tag"), F.lit(score).alias("score"), F.lit(reason).alias("reason"))

    ordered = sorted(R.TAGS, key=lambda t: -t[1])
    found = let(X.lower(text), lambda low: _given(*[(_matches(low, parts, words), struct(tag, score, reason)) for tag, score, reason, parts, words in ordered]))
    return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(struct(*R.FALLBACK_TAG))))


def reasons(suggestions: Column) -> Column:
    return F.transform(suggestions, lambda s: F.concat_ws(":", s["tag"], s["score"].cast("string"), s["reason"]))


#: Up to a line end, one of ! ? ; or a period that ends the text or stands before white space.
_VALUE = r"(?s)^(.*?)(?:[\n\r!?;]|\.(?=[ \t\n\x0B\f\r]|\z)|\z)"


def _atom(key, value, kind, rule, confidence, start, end, snippet) -> Column:
    fields = zip(("key", "value", "type", "rule", "confidence", "start", "end", "snippet"), (key, value, kind, rule, confidence, start, end, snippet))
    return F.struct(*[(x if isinstance(x, Column) else F.lit(x)).alias(n) for n, x in fields]).cast(f"struct<{ATOM.replace(' ', ':').replace(',:', ',')}>")


def _after(text: Column, low: Column, marker: Column, key: str, kind: str, with_marker: bool) -> Column:
    """The atom after the marker's first occurrence, or NULL."""
    rule = F.when(marker == "remember that ", F.lit(R.BARE_RULES["remember that "])).otherwise(F.concat(F.lit("marker:"), marker))

    def whole(at: Column) -> Column:
        begin = at - 1 + F.length(marker)
        rest = F.substring(text, begin + 1, F.length(text))
        return let(rest, lambda r: let(F.regexp_extract(r, _VALUE, 1), lambda v: made(begin, r, v)))

    def made(begin: Column, rest: Column, value: Column) -> Column:
        start = F.octet_length(F.substring(text, F.lit(1), begin))
        end = start + F.when(F.length(value) < F.length(rest), F.octet_length(value)).otherwise(F.octet_length(X.trim(value)))
        snippet = X.trim(value)
        full = X.clean(F.concat(marker, X.clean(value))) if with_marker else X.clean(value)
        shown = X.clean(F.concat(marker, snippet)) if with_marker else snippet
        return F.when(X.clean(value) != "", _atom(key, full, kind, rule, "0.92", start, end, shown))

    return let(F.instr(low, marker), lambda at: F.when(at > 0, whole(at)))


def _specific(atom: Column) -> Column:
    """The key with its topic, or as one of security."""
    base, value = atom["key"], atom["value"]
    secure = (base == "user_constraint") & X.contains_any(X.lower(value), R.SECURITY_TERMS)
    key = F.when(secure, F.lit("user_constraint.security")).when(base.isin(*R.SLUGGED), F.concat(base, F.lit("."), X.slug(value))).otherwise(base)
    return atom.withField("key", key)


def atoms(text: Column) -> Column:
    """Array of atoms of a text, in rule order."""

    def tries(low: Column, key: str, kind: str, with_marker: bool):
        return lambda marker: _after(text, low, marker, key, kind, with_marker)

    def of(low: Column) -> Column:
        found = []
        for key, kind, markers, with_marker in R.MARKERS:
            tried = F.transform(F.array(*map(F.lit, markers)), tries(low, key, kind, with_marker))
            found.append(F.get(F.array_compact(tried), F.lit(0)))
        question = let(X.clean(text), lambda q: F.when(F.contains(text, F.lit("?")) & (q != ""), _atom("open_question", q, "question", "punctuation:question_mark", "0.75", F.lit(0), F.octet_length(text), text)))
        return F.array_compact(F.array(*found, question))

    return F.transform(let(X.lower(text), of), _specific)


def normal_tab(tab: Column) -> Column:
    return let(X.clean(F.coalesce(tab, F.lit(""))), lambda c: F.when(c == "", F.lit("main")).otherwise(c))


def resolve_aliases(aliases: dict[str, str]) -> dict[str, str]:
    """Each alias with the tab that its chain ends at (32 hops at most, a cycle stops)."""
    out = {}
    for alias in aliases:
        tab, seen = alias, set()
        while tab in aliases and tab not in seen and len(seen) < 32:
            seen.add(tab)
            tab = aliases[tab]
        out[alias] = tab
    return out


def resolve_tab(tab: Column, aliases: dict[str, str]) -> Column:
    """The tab a name stands for. The alias table of a context is small and becomes a literal map."""
    known = resolve_aliases(aliases)
    name = normal_tab(tab)
    if not known:
        return name
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return let(name, lambda n: F.coalesce(F.try_element_at(table, n), n))


def messages(raw: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """raw (context, ordinal, message_id, speaker, text, tab, auto_tab) with what a context stores of a message: tab, tags,
    tag_reasons, access_labels, entities, suggested_tab. A NULL text is empty."""
    aliases = aliases or {}
    text = F.coalesce("text", F.lit(""))
    rows = raw.withColumns({"text": text, "access_labels": access_labels(text), "entities": entities(text), "suggestions": tag_suggestions(text)})
    rows = rows.withColumn("suggested_tab", F.col("suggestions")[0]["tag"])
    given = F.col("tab").isNotNull() & (F.col("tab") != "")
    auto = F.coalesce("auto_tab", F.lit(False))
    rows = rows.withColumn("stored_tab", resolve_tab(F.when(auto, F.col("suggested_tab")).otherwise(F.col("tab")), aliases))
    every = F.array_append(F.transform("suggestions", lambda s: s["tag"]), F.col("stored_tab"))
    tags = F.array_sort(F.array_distinct(F.transform(every, lambda t: resolve_tab(t, aliases))))
    why = reasons(F.col("suggestions"))
    explicit = F.array_append(why, F.concat("stored_tab", F.lit(":100:explicit vibe-tab")))
    rows = rows.withColumns({"tags": tags, "tag_reasons": F.when(~auto & given, F.array_distinct(explicit)).otherwise(why)})
    return rows.drop("tab", "suggestions", "auto_tab").withColumnRenamed("stored_tab", "tab")


def exploded(rows: DataFrame) -> DataFrame:
    """One row per atom of messages: context, ordinal (message, then place), the atom, and what it inherits."""
    found = rows.select("context", "ordinal", F.concat(F.lit("message_"), F.col("message_id").cast("string")).alias("source"), "tab", F.array_sort("tags").alias("tags"), "access_labels", F.posexplode(atoms(F.col("text"))).alias("place", "atom"))
    return found.select("context", "ordinal", "place", "source", "tab", "tags", "access_labels", "atom.*")
