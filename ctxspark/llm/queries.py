"""The registered queries of the training-data operators: (spark, sf_dir) to a DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ctxspark.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def _remainder(column: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(column).cast("string")) % n


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str):
    """Fitted on labelled rows whose remainder is not 1."""
    from ctxspark.llm.toxicity import fit, training_sample

    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    known = docs.select(F.col("doc_id").alias("id"), "text").where(_remainder("id", 3) != 1)
    return fit(*training_sample(known, labels))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ctxspark.llm.toxicity import score

    docs = table(spark, sf_dir, "documents")
    scored = score(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select(F.col("id").alias("doc_id"), F.coalesce(_remainder("id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ctxspark.llm.linededup import remove_boilerplate

    kept = remove_boilerplate(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLES["op5_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, source, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM l),
k AS (SELECT doc_id, coalesce(source, chr(0)) AS site, line, pos, trim(line, ' ' || chr(9) || chr(13)) AS key FROM e),
b AS (SELECT key, min((doc_id, pos)) AS first FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT site) >= 10),
m AS (SELECT k.doc_id, k.pos, k.line, b.key IS NOT NULL AND (k.doc_id, k.pos) <> b.first AS gone
      FROM k LEFT JOIN b ON k.key = b.key),
a AS (SELECT doc_id, count(*) AS n_lines, sum(gone::INT) AS n_removed,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id
"""


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ctxspark.llm.decontam import contaminated

    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "n_shingles", "n_shared", "containment")


ORACLES["op7_decontamination"] = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower_ascii, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)),
v AS (SELECT item_id, list_filter(string_split_regex(lower_ascii, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM (SELECT item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM benchmark)),
i AS (SELECT item_id, least(5, len(ws)) AS n, unnest(list_distinct(list_transform(range(1, len(ws) - least(5, len(ws)) + 2),
        lambda k: array_to_string(ws[k:k + least(5, len(ws)) - 1], ' ')))) AS g FROM v WHERE len(ws) > 0),
z AS (SELECT item_id, n, count(*) AS n_shingles FROM i GROUP BY item_id, n),
ns AS (SELECT DISTINCT n FROM z),
d AS (SELECT doc_id, n, unnest(list_distinct(list_transform(range(1, len(ws) - n + 2), lambda k: array_to_string(ws[k:k + n - 1], ' ')))) AS g
      FROM w, ns WHERE len(ws) >= n),
s AS (SELECT doc_id, i.item_id, i.n, count(*) AS n_shared FROM d JOIN i ON d.g = i.g AND d.n = i.n GROUP BY doc_id, i.item_id, i.n)
SELECT doc_id, s.item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
FROM s JOIN z ON s.item_id = z.item_id WHERE n_shared >= ceil(0.8 * n_shingles - 1e-9)
"""


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ctxspark.llm.packing import pack

    return packed(pack(table(spark, sf_dir, "documents")))


def packed(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc32").alias("ids_crc32"), "sequence_id", "offset")


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ctxspark.llm.language import fit, identify, training_sample

    docs = table(spark, sf_dir, "documents")
    model = fit(*training_sample(docs.where(_remainder("doc_id", 4) != 2).select("text", "lang")))
    found = identify(docs, model)
    return found.select(F.col("id").alias("doc_id"), F.coalesce(_remainder("id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ctxspark.llm.attribution import section_tokens

    counted = section_tokens(table(spark, sf_dir, "documents"))
    return counted.withColumnRenamed("id", "doc_id").withColumn("n_tokens", F.col("n_tokens").cast("long"))


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ctxspark.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _license_sql() -> str:
    from ctxspark.llm.licenses import BLOCK_STEP, BLOCK_WORDS, CONTAINMENT, PHRASES, TEMPLATES

    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in PHRASES)
    templates = ", ".join(f"({k}, '{t}', '{label}')" for k, (t, label) in enumerate(TEMPLATES))
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}') AS w FROM documents),
p(phrase, label) AS (VALUES {phrases}),
h AS (SELECT doc_id, label, unnest(list_filter(range(0, len(w) - len(string_split(phrase, ' ')) + 1),
        lambda i: array_to_string(w[i + 1:i + len(string_split(phrase, ' '))], ' ') = phrase)) AS place FROM d, p WHERE len(w) >= len(string_split(phrase, ' '))),
b AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM h GROUP BY doc_id),
t AS (SELECT k, label, list_distinct(string_split(body, ' ')) AS own FROM (VALUES {templates}) x(k, body, label)),
n AS (SELECT doc_id, w, k, label, own FROM d, t WHERE len(list_intersect(own, w)) >= ceil({CONTAINMENT} * len(own) - 1e-9)),
o AS (SELECT *, unnest(range(0, greatest(len(w) - {BLOCK_WORDS - BLOCK_STEP + 1}, 0) + 1, {BLOCK_STEP})) AS block FROM n),
s AS (SELECT doc_id, block, k, label, len(own) AS size, list_intersect(own, w[block + 1:block + {BLOCK_WORDS}]) AS met FROM o),
m AS (SELECT *, len(met) / size AS share FROM s WHERE len(met) >= ceil({CONTAINMENT} * size - 1e-9)),
g AS (SELECT doc_id, label, share FROM m x WHERE NOT EXISTS (SELECT 1 FROM m y WHERE x.doc_id = y.doc_id AND x.block = y.block AND x.k <> y.k
        AND list_has_all(y.met, x.met) AND (len(y.met) > len(x.met) OR y.share > x.share))),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM g UNION ALL SELECT doc_id, label FROM h) GROUP BY doc_id),
c AS (SELECT doc_id, max(share) AS share FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS DOUBLE) AS score
FROM d LEFT JOIN b ON d.doc_id = b.doc_id LEFT JOIN a ON d.doc_id = a.doc_id LEFT JOIN c ON d.doc_id = c.doc_id
"""


ORACLES["op3_license_scan"] = _license_sql()


@query
def op2_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ctxspark.llm.mtree import top_k

    raw = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    whole = raw.where("e is not null").where(~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    scaled = whole.select(F.col("vec_id").alias("id"), F.transform("e", lambda x: F.floor(x * 256)).alias("vector"))
    return top_k(scaled, F.col("id") % 50 == 0).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


ORACLES["op2_mtree_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ctxspark.llm.fmindex import dedup_passages

    kept = dedup_passages(table(spark, sf_dir, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op6_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(0, len(w) - 19)) AS a, w FROM d WHERE len(w) >= 20),
h AS (SELECT doc_id, a, md5(array_to_string(w[a + 1:a + 20], ' ')) AS g FROM s),
f AS (SELECT g, min((doc_id, a)) AS first FROM h GROUP BY g HAVING count(*) > 1),
r AS (SELECT h.doc_id, h.a FROM h JOIN f ON h.g = f.g WHERE (h.doc_id, h.a) <> f.first),
c AS (SELECT DISTINCT doc_id, unnest(range(a, a + 20)) AS pos FROM r),
e AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
k AS (SELECT e.doc_id, count(*) AS n_words, count(c.pos) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY e.pos) FILTER (c.pos IS NULL), '') AS kept
      FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.pos = c.pos GROUP BY e.doc_id)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
