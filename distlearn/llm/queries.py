"""One query per operator over the whole driver tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import (
    bpe, conversation_trie, extract, language_model, mixing, neighbours, passages, secret_scan, simhash, spellings, token_counts, toxicity, vector_dedup,
)
from .common import fold

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


VECTORS_SQL = """v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"""

NEAREST_SQL = f"""
WITH {VECTORS_SQL},
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_cosine_similarity(q.e, d.e) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.e) = len(d.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""


@query("op1_nearest_neighbours", NEAREST_SQL)
def nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    found = neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.withColumnRenamed("id", "vec_id")


@query("op2_main_text")
def main_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract.extract(table(spark, folder, "pages"))


def _spans_sql(at: int, rule: secret_scan.Rule) -> str:
    p = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {at} AS pos, '{rule.kind}' AS kind, start, start + length(ms[i]) AS stop FROM (
    SELECT doc_id, ms, gs, i, CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
    FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, '{p}', 0) AS ms, regexp_extract_all(text, '{p}', {rule.group}) AS gs, string_split_regex(text, '{p}') AS ps FROM documents)))
  WHERE length(gs[i]) >= {rule.least}"""


SECRETS_SQL = f"""
WITH spans AS ({" UNION ALL ".join(_spans_sql(at, r) for at, r in enumerate(secret_scan.BASE + secret_scan.FURTHER))}),
listed AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, pos) FILTER (WHERE pos < {len(secret_scan.BASE)}) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, pos) AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN listed USING (doc_id)
"""


@query("op3_secrets", SECRETS_SQL)
def secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(table(spark, folder, "documents").select("doc_id", "text")))


@query("op4_simhash")
def simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op5_toxicity")
def toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.train(docs, table(spark, folder, "labels"), fold(4) != 2)
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", (fold(4) == 2).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )


LINKS_SQL = f"""
WITH RECURSIVE {VECTORS_SQL},
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN least ON least.a = vec_id LEFT JOIN counts ON counts.a = vec_id
"""


@query("op6_vector_dedup", LINKS_SQL)
def vector_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, folder, "embeddings"))


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix' || coalesce(CAST(doc_id AS VARCHAR), 'null' || md5(coalesce(text, '')))) AS k
  FROM documents),
sources AS (SELECT source, sum(size) AS n FROM sized GROUP BY source),
weighted AS (
  SELECT source, CAST(n AS BIGINT) AS n, 3 * CAST(n AS BIGINT) AS cap,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS pos
  FROM sources),
levels AS (
  SELECT *, CAST(sum(n) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / sum(w) OVER (ORDER BY cap / w, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted),
targets AS (
  SELECT source, n, least(CAST(cap AS DOUBLE), max(level) OVER () * w) AS target FROM levels),
budgets AS (
  SELECT source, n, target, CASE WHEN n > 0 THEN CAST(floor(floor(target + 0.5) / n) AS BIGINT) ELSE 0 END AS epochs,
         CAST(floor(target + 0.5) AS BIGINT) AS budget
  FROM targets),
ordered AS (
  SELECT s.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s)
SELECT doc_id, size, n AS source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * n - before)) AS BIGINT) AS taken
FROM ordered o JOIN budgets b ON o.source IS NOT DISTINCT FROM b.source
"""


@query("op7_mix_sources", MIX_SQL)
def mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, folder, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


@query("op8_language_model")
def language_model_scores(spark: SparkSession, folder: str) -> DataFrame:
    scored = language_model.score(table(spark, folder, "documents"), fold(5) != 1)
    return scored.select("doc_id", (fold(5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op9_byte_bpe")
def byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


REPEATS_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM docs)),
firsts AS (SELECT w, min(doc_id) AS least FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS at FROM windows JOIN firsts USING (w) WHERE least < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS at FROM docs),
kept AS (
  SELECT words.doc_id, count(gone.at) AS n_removed, string_agg(word, ' ' ORDER BY words.at) FILTER (WHERE gone.at IS NULL) AS text
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.at = words.at GROUP BY words.doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""


@query("op10_repeated_passages", REPEATS_SQL)
def repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    found = passages.remove_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op11_token_counts")
def token_totals(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts.count_tokens(table(spark, folder, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


# crc32 by its table, and of a list of bytes
CRC_SQL = "crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))) ORDER BY i) AS tab FROM range(256) r(i))"


def _crc_sql(text: str) -> str:
    data = f"list_transform(range(0, len(hex({text})) // 2), lambda i: CAST('0x' || substr(hex({text}), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda a, b: xor(a >> 8, tab[xor(a & 255, b) + 1])), 4294967295)"


TRIE_SQL = f"""
WITH {CRC_SQL},
own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, {_crc_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM own), crc),
parts AS (
  SELECT c.conv_id, pos, role, text FROM convs c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 5 AND pos <= h
  UNION ALL SELECT c.conv_id, pos, role, text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND pos > h),
seqs AS (
  SELECT conv_id, coalesce(list(md5(length(role) || ':' || role || text) ORDER BY pos) FILTER (pos IS NOT NULL), []) AS ks,
         list(strlen(text) ORDER BY pos) AS sizes
  FROM convs LEFT JOIN parts USING (conv_id) GROUP BY conv_id),
members AS (
  SELECT conv_id, depth, array_to_string(ks[1:depth], ' ') AS node, coalesce(sizes[depth], 0) AS size, depth = len(ks) AS ends
  FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS depth FROM seqs)),
nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ids
  FROM members GROUP BY node, depth),
above AS (SELECT *, unnest(range(0, depth + 1)) AS up FROM nodes),
kids AS (SELECT left(node, 33 * up - 1 + (up = 0)::INT) AS node, up AS depth, count(*) AS n FROM above WHERE up = depth - 1 GROUP BY ALL),
sums AS (
  SELECT left(a.node, 33 * up - 1 + (up = 0)::INT) AS node, up AS depth, count(*) FILTER (k.n IS NULL) AS n_leaves, sum((n_convs - 1) * size) AS saved
  FROM above a LEFT JOIN kids k ON k.node = a.node AND k.depth = a.depth GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
       sha256(n.ids) AS ends_sha256
FROM nodes n JOIN sums s ON s.node = n.node AND s.depth = n.depth LEFT JOIN kids k ON k.node = n.node AND k.depth = n.depth
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = left(n.node, greatest(33 * (n.depth - 1) - 1, 0))
"""


@query("op12_prefix_trie", TRIE_SQL)
def prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, folder, "conversations"))


SPELLINGS_SQL = f"""
WITH RECURSIVE {CRC_SQL},
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{spellings.UPPER}', '{spellings.LOWER}'), '{spellings.RUN}')) AS run FROM documents),
hashed AS (
  SELECT run, k, {_crc_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h
  FROM (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= 7 GROUP BY ALL), crc),
words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n
  FROM (SELECT k, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cuts AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS c FROM (SELECT *, unnest(range(0, length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.i = b.i AND a.c = b.c AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.c = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.c = b.word),
ranked AS (
  SELECT word, count(*) OVER (PARTITION BY word) AS n_near, other, n AS form_n, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS r FROM near),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * w.n THEN other END AS form, CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.r = 1),
paths AS (SELECT word, word AS at FROM words UNION ALL SELECT p.word, f.form FROM paths p JOIN forms f ON f.word = p.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, p.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN paths p USING (word) JOIN forms last ON last.word = p.at WHERE last.form IS NULL
"""


@query("op13_spelling_variants", SPELLINGS_SQL)
def spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spellings.group_spellings(table(spark, folder, "documents"))
