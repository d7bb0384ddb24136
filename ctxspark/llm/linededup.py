"""Cross-site boilerplate lines: HyperLogLog sketches of the sites per line hash, exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxspark.llm.common import cut

#: A line is boilerplate on so many distinct sites or more.
MIN_SITES = 10
LG_K = 12
#: Estimates within this share of the threshold are counted exactly: over six standard errors of a sketch of LG_K.
MARGIN = 0.1
BLANK = " \t\r"


def lines_of(text: Column) -> Column:
    """The lines of a text between line feeds; none for a null text."""
    return F.coalesce(F.split(text, "\n"), F.array().cast("array<string>"))


def line_table(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(h, g, site, id, row, pos): the hashes of each non-blank line, trimmed of blanks, with its site and place; row is
    the hash of the whole text, which tells apart rows that repeat an id. A null site is a site of its own."""
    site = F.coalesce(F.col(site_col).cast("string"), F.lit("\0"))
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), site.alias("site"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
    line = F.trim("line", F.lit(BLANK))
    return lines.where(line != "").select(F.xxhash64(line).alias("h"), F.hash(line).alias("g"), "site", "id", "row", "pos")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, margin: float = MARGIN) -> DataFrame:
    """(h, g) of the lines on at least min_sites distinct sites. Each task sketches its own lines, sketches of one line
    merge in the aggregation, and only lines whose estimate is near min_sites are counted exactly."""
    sketched = lines.groupBy("h", "g").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"))
    likely = cut(sketched.where(F.col("sites") >= min_sites * (1 - margin)))
    near = likely.where(F.col("sites") <= min_sites * (1 + margin)).select("h", "g")
    exact = lines.join(near, ["h", "g"]).groupBy("h", "g", "site").agg(F.count("*").alias("n")).groupBy("h", "g").agg(F.count("*").alias("sites"))
    sure = likely.where(F.col("sites") > min_sites * (1 + margin)).select("h", "g")
    return cut(sure.unionByName(exact.where(F.col("sites") >= min_sites).select("h", "g")))


def dropped_lines(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_sites: int = MIN_SITES) -> DataFrame:
    """(id, row, dropped): per text that loses lines, their places (from 0)."""
    lines = cut(line_table(docs, id_col, text_col, site_col))
    there = cut(lines.join(boilerplate(lines, min_sites), ["h", "g"]).select("h", "g", "id", "row", "pos"))
    first = cut(there.groupBy("h", "g").agg(F.min(F.struct("id", "pos")).alias("first")))
    again = there.join(first, ["h", "g"]).where(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("pos") == F.col("first.pos"))))
    return again.where("id is not null").groupBy("id", "row").agg(F.collect_set("pos").alias("dropped"))


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """docs with the text rid of cross-site boilerplate: every line that stands on min_sites sites or more goes, but for
    its first occurrence (smallest id, then place), so nothing leaves the corpus altogether. All columns stay, and two
    are appended in place of any of the same name: n_lines (all lines, blank ones too) and n_removed.

    Lines are compared without blanks at their ends; blank lines stay. A null text has no lines and stays null. Rows
    with a null id keep all their lines, which count for the spread. Rows that repeat an id are told apart by their
    texts: each loses its own lines only, and of lines at one place of one id all count as first. The texts are shuffled once, next to the lists of places that each loses: both grow with the input, so neither is
    broadcast."""
    clash = [c for c in docs.columns if c.lower() in ("n_lines", "n_removed")]
    docs = docs.drop(*clash)
    drops = cut(dropped_lines(docs, id_col, text_col, site_col, min_sites))
    lines = lines_of(F.col(text_col))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__dropped"))
    text = F.when(F.col("__dropped").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    drops = drops.select(F.col("id").alias("__id"), F.col("row").alias("__row"), F.col("dropped").alias("__dropped"))
    joined = docs.join(drops.hint("merge"), (F.col(id_col) == F.col("__id")) & (F.xxhash64(text_col) == F.col("__row")), "left")
    columns = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns, F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("__dropped"), F.lit(0)).cast("long").alias("n_removed"))
