"""The named queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripchain.llm import (
    ann, bpe, centroids, chat, decontaminate, html_text, jaccard, merkle, quality, sharding, simhash, substrings, token_counts)
from tripchain.llm.common import table

VOCABULARY = "byte_bpe_50k.json"
Query = Callable[[SparkSession, str], DataFrame]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_documents(table(spark, sf_dir, "documents"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    # Fixed values of the planted conversation.
    said = "</s>[INST] ok [/INST]"
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat.digests(chat.prefix_targets(turns))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(table(spark, sf_dir, "documents"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in (
        op1_decontaminate, op2_quality, op3_html_text, op4_bpe, op5_shards, op6_jaccard, op7_substrings, op8_chat, op9_token_counts, op10_ann,
        op11_merkle, op12_simhash, op13_centroids)}


_LT = r"(<)(\\*)(\|im_(?:start|sep|end)\|>|/?s>|</?SYS>>)"
_SQ = r"(\[)(\\*)(/?INST\])"

_CHAT_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, 33 + length(regexp_replace(regexp_replace(role, '{_LT}', '\1\\\2\3', 'g'), '{_SQ}', '\1\\\2\3', 'g'))
              + length(regexp_replace(regexp_replace(text, '{_LT}', '\1\\\2\3', 'g'), '{_SQ}', '\1\\\2\3', 'g')) AS shown,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM turns
), counted AS (
  SELECT *, count(*) FILTER (role = 'assistant' OR pos = n) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS used
  FROM escaped
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(shown * used) AS BIGINT) AS formatted_chars
FROM counted GROUP BY conv_id
"""


_DECONTAMINATE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item, w[i : i + 9] AS win
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT len(win) AS n FROM windows
), starts AS (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n
), hits AS (
  SELECT s.r, s.i, s.n, x.item FROM (SELECT r, i, n, w[i : i + n - 1] AS win FROM starts) s JOIN windows x ON s.win = x.win
), counted AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN counted USING (r) LEFT JOIN named USING (r)
"""


def _leaf_sql(text: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


def _grown_sql(name: str, leaves: str) -> str:
    """A tree for each ``grp`` of ``leaves`` (grp, pos, node, size), every node with its run."""
    return f"""{name}(grp, lvl, pos, node, size) AS (
  SELECT grp, 0, pos, node, size FROM {leaves}
  UNION ALL
  SELECT grp, any_value(lvl) + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (any_value(size) + 2) // 3
  FROM {name} WHERE size > 1 GROUP BY grp, pos // 3
), {name}_steps AS (
  SELECT a.grp, a.lvl, a.pos, string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos) AS l,
         string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos) AS r
  FROM {name} a JOIN {name} b ON b.grp = a.grp AND b.lvl = a.lvl AND b.pos // 3 = a.pos // 3 WHERE a.size > 1 GROUP BY ALL
)"""


# The CRC is computed bit by bit over the digits.
_MERKLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || source, '-') AS grp, {_leaf_sql('text')} AS node, {_leaf_sql("replace(text, chr(10), '')")} AS cut,
         xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda crc, b:
             list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda v, i: CASE WHEN (v & 1) = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(crc, b)),
             4294967295::BIGINT)) AS crc
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, node) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS size FROM d
), {_grown_sql('low', 'placed')}, heads AS (
  SELECT '' AS grp, grp AS name, node, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS size FROM low WHERE size = 1
), {_grown_sql('high', 'heads')}, path AS (
  SELECT p.grp, p.pos, s.lvl, s.l, s.r FROM placed p JOIN low_steps s ON s.grp = p.grp AND s.pos = p.pos // (3 ** s.lvl)::BIGINT
  UNION ALL
  SELECT p.grp, p.pos, 100 + s.lvl, s.l, s.r FROM placed p JOIN heads h ON h.name = p.grp JOIN high_steps s ON s.pos = h.pos // (3 ** s.lvl)::BIGINT
), proof AS (
  SELECT grp, pos, list({{'l': coalesce(l, ''), 'r': coalesce(r, '')}} ORDER BY lvl) AS steps,
         string_agg(coalesce(l, '') || coalesce(r, ''), '' ORDER BY lvl) AS beside FROM path GROUP BY ALL
), told AS (
  SELECT p.doc_id, p.node AS leaf, h.node AS subroot, (SELECT node FROM high WHERE size = 1) AS root, coalesce(f.beside, '') AS beside,
         list_reduce(coalesce(f.steps, []), lambda a, s: {{'l': sha256(s.l || a.l || s.r), 'r': ''}},
                     {{'l': CASE WHEN p.crc % 2 = 0 THEN p.cut ELSE p.node END, 'r': ''}}).l AS folded
  FROM placed p JOIN heads h ON h.name = p.grp LEFT JOIN proof f ON f.grp = p.grp AND f.pos = p.pos
)
SELECT doc_id, leaf, subroot, root, sha256(beside) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM told
"""


def _clusters_sql(rounds: int) -> str:
    """Rounds one after the other, every vector against every centroid; c0, c1 … are the centroids after so many rounds."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS (
  SELECT n, any_value(vec_id) AS vec_id, any_value(x) AS x, min({{'d': d, 'c': c}}) AS best
  FROM (SELECT v.n, v.vec_id, v.x, k.c, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - k.x[i]) * (v.x[i] - k.x[i])))::BIGINT AS d
        FROM v, c{i} k) GROUP BY n
)""")
        if i < rounds:
            steps.append(f"""m{i} AS (
  SELECT c, list(m ORDER BY i) AS x FROM (
    SELECT best.c AS c, i, ((sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
    FROM a{i}, range(1, 65) r(i) GROUP BY ALL) GROUP BY c
), c{i + 1} AS (SELECT k.c, coalesce(m.x, k.x) AS x FROM c{i} k LEFT JOIN m{i} m ON m.c = k.c)""")
    return ",\n".join(steps)


_CENTROIDS_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, x) - 1 AS c, x FROM v ORDER BY sha256('1:' || vec_id) NULLS LAST, x LIMIT 16
), {_clusters_sql(3)}
SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia,
       sum(best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(k.x, ',')) AS centroid_sha256
FROM a3 JOIN c3 k ON k.c = best.c
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": _DECONTAMINATE_SQL, "op8_chat": _CHAT_SQL, "op11_merkle": _MERKLE_SQL, "op13_centroids": _CENTROIDS_SQL}
