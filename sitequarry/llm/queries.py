"""The queries of the training-data operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff_lm, binary_records, curve_packing, edit_fingerprint, html_extract, lexical_search, merkle, quality, simhash, source_mix, suffix_dedup, token_rollup, topk_search
from .common import materialised, shared_folder, table
from .tokens import public_path


def op1_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With class_id, of what bands and verification link, beside the columns asked for."""
    return edit_fingerprint.near_classes(materialised(edit_fingerprint.fingerprints(table(spark, sf_dir, "documents"))))


def op2_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.score(table(spark, sf_dir, "documents"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in, all lose their repeated lines (a batch that is sent twice), and exact copies go again."""
    versions = {"byte_bpe_50k": public_path("byte_bpe_50k.json"), "byte_bpe_multi_50k": public_path("byte_bpe_multi_50k.tiktoken")}
    rows = materialised(token_rollup.counted(table(spark, sf_dir, "documents"), versions))
    rollup = token_rollup.TokenRollup(spark, f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.commit("1-insert", token_rollup.inserts(rows))
    changed = rows.where("tokens <> revised_tokens")
    for _ in range(2):
        rollup.commit("2-revise", token_rollup.revisions(changed, changed, "tokens", "revised_tokens"))
    rollup.commit("3-delete", token_rollup.copies(rows, "revised_tokens"))
    return rollup.totals()


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve_packing.pack(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from the files."""
    return binary_records.write(table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/records-{uuid.uuid4().hex}").records()


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampered rows, those of an even crc32 of their id, lose their line feeds."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return merkle.tamper_check(table(spark, sf_dir, "documents"), even, F.replace("text", F.lit("\n"), F.lit("")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


LEXICAL_SQL = """
WITH term AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM documents),
asked AS (SELECT item_id, t, count(*) AS q FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
doc AS (SELECT doc_id, count(*)::BIGINT AS n FROM term GROUP BY doc_id),
a AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM doc),
tf AS (SELECT doc_id, t, count(*)::BIGINT AS tf FROM term GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
w AS (SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, a),
m AS (SELECT doc_id, 25 + (75 * n * nn) // ll AS m FROM doc, a),
s AS (SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM asked JOIN tf USING (t) JOIN w USING (t) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


#: "-" or the length in bytes, a colon and the value, of each field; crc32 by its shifts; siblings by level; and a fold over them.
MERKLE_SQL = """
WITH RECURSIVE f AS (SELECT row_number() OVER () AS rid, doc_id, source, text,
  concat_ws('', coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
  list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) & 1 = 1 AS changed FROM documents),
t AS (SELECT *, CASE WHEN changed THEN replace(text, chr(10), '') ELSE text END AS other FROM f),
h AS (SELECT rid, doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS other FROM t),
leaf AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM h),
tree AS (SELECT g, 0 AS lvl, i, n, leaf AS h FROM leaf UNION ALL SELECT g, lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY g, lvl, i // 3, n),
sub AS (SELECT g, h FROM tree WHERE n = 1),
crown AS (SELECT 0 AS lvl, g AS i, count(*) OVER () AS n, h FROM sub UNION ALL SELECT lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM crown WHERE n > 1 GROUP BY lvl, i // 3, n),
both_trees AS (SELECT rid, 0 AS part, lvl, t.i, leaf.i // (3 ** lvl)::BIGINT AS own, h FROM leaf JOIN tree t ON t.g = leaf.g AND t.n > 1 AND t.i // 3 = leaf.i // (3 ** (lvl + 1))::BIGINT
  UNION ALL SELECT rid, 1, lvl, c.i, leaf.g // (3 ** lvl)::BIGINT, h FROM leaf JOIN crown c ON c.n > 1 AND c.i // 3 = leaf.g // (3 ** (lvl + 1))::BIGINT),
sib AS (SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY part, lvl) AS step, coalesce(string_agg(h, '' ORDER BY i) FILTER (i < own), '') AS a, coalesce(string_agg(h, '' ORDER BY i) FILTER (i > own), '') AS z FROM both_trees GROUP BY rid, part, lvl),
proof AS (SELECT rid, string_agg(a || z, '' ORDER BY step) AS p, max(step) AS steps FROM sib GROUP BY rid),
fold AS (SELECT rid, 0 AS step, other AS h FROM leaf UNION ALL SELECT rid, sib.step, sha256(a || h || z) FROM fold JOIN sib USING (rid) WHERE sib.step = fold.step + 1)
SELECT doc_id, leaf, sub.h AS subroot, top.h AS root, sha256(coalesce(p, '')) AS proof_sha256, fold.h AS folded_root, fold.h = top.h AS verified
FROM leaf JOIN crown top ON top.n = 1 JOIN sub USING (g) LEFT JOIN proof USING (rid) JOIN fold ON fold.rid = leaf.rid AND fold.step = coalesce(steps, 0)
"""


SUFFIX_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d)),
m AS (SELECT s, min(doc_id) AS first_id FROM g GROUP BY s HAVING min(doc_id) < max(doc_id)),
c AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM g JOIN m USING (s) WHERE first_id < doc_id),
n AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM c),
p AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS z FROM n GROUP BY doc_id, k),
q AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM p),
r AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept FROM q JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, d.h))) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_suffix_dedup": SUFFIX_SQL, "op9_topk_search": TOPK_SQL, "op11_lexical_search": LEXICAL_SQL, "op13_merkle_manifest": MERKLE_SQL}
