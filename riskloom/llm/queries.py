"""The contract queries of the numbered operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.decontamination import contained_items
from riskloom.llm.exact_dedup import radix_dedup
from riskloom.llm.jaccard import link_classes
from riskloom.llm.language_id import identify
from riskloom.llm.line_dedup import dedup_lines
from riskloom.llm.lm_scoring import held_out_expr, score_texts
from riskloom.llm.packing import pack
from riskloom.llm.quality import judge
from riskloom.llm.resampling import resample
from riskloom.llm.sharding import claim_slots, place
from riskloom.llm.simhash import fingerprint_hex, near_dedup
from riskloom.llm.toxicity import score_toxicity
from riskloom.llm.whitening import whiten

SHARDS, SLOTS = [f"shard-{i:02d}" for i in range(64)], 8191


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup(_docs(spark, sf_dir))
    return found.select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_docs(spark, sf_dir), lambda c: held_out_expr(c, 5, 1))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(_docs(spark, sf_dir).select("doc_id"), SHARDS, SLOTS).select("doc_id", "slot", "shard")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(_docs(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_docs(spark, sf_dir), with_ids=False)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_docs(spark, sf_dir), lambda c: held_out_expr(c, 5, 0))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("row_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), lambda c: held_out_expr(c, 3, 1))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix_dedup(_docs(spark, sf_dir)).drop("row_id")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("n_words")


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_classes(_docs(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_near_dedup": op1_simhash_near_dedup,
        "op2_lm_scoring": op2_lm_scoring,
        "op3_decontamination": op3_decontamination,
        "op4_sharding": op4_sharding,
        "op5_line_dedup": op5_line_dedup,
        "op6_packing": op6_packing,
        "op7_language_id": op7_language_id,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_toxicity": op9_toxicity,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_embedding_whitening": op11_embedding_whitening,
        "op12_importance_resampling": op12_importance_resampling,
        "op13_ngram_jaccard_join": op13_ngram_jaccard_join,
    }


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP10_SQL = f"""
WITH d AS (SELECT doc_id, {_LOWERED} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


OP5_SQL = """
WITH l AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.last AS lost FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (lost) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


_WORDS = "list_filter(string_split_regex({0}, '[' || chr(32) || chr(9) || '-' || chr(13) || ']+'), lambda w: w <> '')".format(_LOWERED)

OP3_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM d WHERE len(w) >= 5),
bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM b WHERE len(w) >= 5),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
h AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs ON ds.s = bs.s GROUP BY doc_id, item_id)
SELECT doc_id, h.item_id, n_shared, n_item FROM h JOIN n ON h.item_id = n.item_id WHERE n_shared >= n_item * 0.8
"""


def op4_sql() -> str:
    owners = ",".join(map(str, claim_slots(SHARDS, SLOTS)))
    return f"""
WITH d AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) % {SLOTS} AS INTEGER) AS slot FROM documents)
SELECT doc_id, slot, CAST(([{owners}])[slot + 1] AS INTEGER) AS shard FROM d
"""


#: The CRC-32 of a feature is the XOR of what each byte adds at its distance from the end, and that of as many zero bytes.
OP12_SQL = f"""
WITH RECURSIVE
byte AS (SELECT CAST(i AS UBIGINT) AS b, CAST(i AS UBIGINT) AS c, 0 AS k FROM range(256) t(i)
         UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM byte WHERE k < 8),
step AS MATERIALIZED (SELECT b, c FROM byte WHERE k = 8),
raw AS (
    SELECT 'd' AS side, doc_id AS id, list_filter(string_split_regex({_LOWERED}, '[' || chr(1) || '-/:-`{{-' || chr(127) || ']+'), lambda w: w <> '') AS w FROM documents
    UNION ALL SELECT 'b', item_id, list_filter(string_split_regex({_LOWERED}, '[' || chr(1) || '-/:-`{{-' || chr(127) || ']+'), lambda w: w <> '') FROM benchmark),
each AS MATERIALIZED (
    SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' ')), list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) AS f FROM raw),
feature AS MATERIALIZED (SELECT f, encode(f) AS bytes, row_number() OVER () AS fid FROM (SELECT DISTINCT f FROM each)),
far AS (SELECT b, c, 0 AS dist FROM step
        UNION ALL SELECT far.b, xor(far.c >> 8, step.c), dist + 1 FROM far JOIN step ON step.b = far.c & 255 WHERE dist < (SELECT max(octet_length(bytes)) FROM feature)),
zero AS (SELECT 4294967295::UBIGINT AS c, 0 AS n
         UNION ALL SELECT xor(zero.c >> 8, step.c), n + 1 FROM zero JOIN step ON step.b = zero.c & 255 WHERE n < (SELECT max(octet_length(bytes)) FROM feature)),
spread AS (
    SELECT fid, octet_length(bytes) - i AS dist, CAST('0x' || substr(hex(bytes), CAST(2 * i - 1 AS BIGINT), 2) AS UBIGINT) AS b
    FROM (SELECT fid, bytes, unnest(range(1, octet_length(bytes) + 1)) AS i FROM feature)),
crc AS (SELECT fid, bit_xor(far.c) AS c FROM spread JOIN far ON far.b = spread.b AND far.dist = spread.dist GROUP BY fid),
bucket AS MATERIALIZED (
    SELECT f, CAST(xor(xor(crc.c, zero.c), 4294967295::UBIGINT) % 10000 AS INTEGER) AS k
    FROM feature JOIN crc ON crc.fid = feature.fid JOIN zero ON zero.n = octet_length(bytes)),
held AS MATERIALIZED (SELECT side, id, k FROM each JOIN bucket ON each.f = bucket.f),
counts AS MATERIALIZED (SELECT k, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM held GROUP BY k),
total AS MATERIALIZED (SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM counts),
gain AS MATERIALIZED (SELECT k, CAST(floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000::DOUBLE) / ((s + 1)::DOUBLE * (all_t + 10000::DOUBLE)))) AS BIGINT) AS g FROM counts, total),
weighed AS (SELECT id, count(*) AS n_features, sum(g) AS weight FROM held JOIN gain ON held.k = gain.k WHERE side = 'd' GROUP BY id),
scored AS (
    SELECT raw.id AS doc_id, coalesce(n_features, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, len(w) >= 20 AS able,
           CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || raw.id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
    FROM raw LEFT JOIN weighed ON raw.id = weighed.id WHERE side = 'd'),
placed AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) FILTER (able) OVER () AS n FROM scored)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CAST(CASE WHEN able AND place <= 5 * n // 100 THEN place END AS BIGINT) AS rank FROM placed
"""


OP13_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS MATERIALIZED (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
h AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM h JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT e.y, r.root FROM r JOIN e ON r.node = e.x)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(root) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN r ON r.node = d.doc_id GROUP BY d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": OP3_SQL, "op4_sharding": op4_sql(), "op5_line_dedup": OP5_SQL, "op10_exact_dedup": OP10_SQL, "op12_importance_resampling": OP12_SQL, "op13_ngram_jaccard_join": OP13_SQL}
