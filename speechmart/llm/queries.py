"""The thin queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .balanced_postings import nearest
from .common import table
from .conversation_repair import audit_conversations, damage
from .exact_dedup import dedup_exact
from .html_extract import extract_pages
from .language_id import identify
from .merkle import manifest
from .near_dedup import near_duplicates
from .packing import pack_documents
from .pii import scan_documents
from .secrets import scan_secrets
from .sentencepiece_codec import encode_documents
from .sharding import shard_documents
from .topk import top_k

Query = Callable[[SparkSession, str], DataFrame]


def op4_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return scan_secrets(table(spark, sf_dir, "documents")).drop("span_list")


def op8_crf_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract_pages(table(spark, sf_dir, "pages"))


def op9_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents."""
    return identify(table(spark, sf_dir, "documents"))


def op1_uniform_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for every row whose id is divisible by 20."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_prefix_table_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of all documents, as digests."""
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_anchor_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return scan_documents(table(spark, sf_dir, "documents"))


def op5_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 1024 ids."""
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of all documents."""
    return shard_documents(table(spark, sf_dir, "documents"))


def op7_cuckoo_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies among all documents."""
    return dedup_exact(table(spark, sf_dir, "documents"))


def op10_odd_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_block_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of all documents, checked against tampered ones."""
    return manifest(table(spark, sf_dir, "documents"))


def op12_balanced_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found for every row whose id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_composed_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repairs of all conversations, after planted damage."""
    conversations = table(spark, sf_dir, "conversations")
    return audit_conversations(damage(conversations), conversations)


def queries() -> dict[str, Query]:
    """Name to query."""
    known = (
        op1_uniform_threshold, op2_prefix_table_codec, op3_anchor_pii, op4_credential_links, op5_bin_slack_packing, op6_virtual_slots, op7_cuckoo_dedup,
        op8_crf_extract, op9_ecoc_language, op10_odd_sketch_dedup, op11_block_manifest, op12_balanced_postings, op13_composed_repair,
    )
    return {f.__name__: f for f in known}


DEDUP_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 20
"""


#: All pairs of texts that share a shingle, their links, and all that is reachable over them.
NEAR_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh
  FROM d
), n AS MATERIALIZED (
  SELECT doc_id, len(sh) AS n FROM s
), e AS MATERIALIZED (
  SELECT doc_id, unnest(sh) AS h FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL
), l AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), g AS MATERIALIZED (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS one, doc_id AS other FROM n UNION SELECT r.one, g.b FROM r JOIN g ON g.a = r.other
)
SELECT n.doc_id, n.n AS n_shingles, min(r.other) AS component_id, n.doc_id = min(r.other) AS kept FROM n JOIN r ON r.one = n.doc_id GROUP BY n.doc_id, n.n
"""


def _crc32(text: str) -> str:
    """SQL for the unsigned crc32 of an ASCII text."""
    return f"""(4294967295 - list_reduce(list_concat([4294967295], list_transform(string_split({text}, ''), lambda c: CAST(ord(c) AS BIGINT))),
      lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""


def _encoded(value: str) -> str:
    return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || CAST({value} AS VARCHAR), '-')"


_LEAF = "sha256(" + " || ".join(_encoded(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _tree(name: str, leaves: str) -> str:
    """SQL of all nodes of the trees over ``leaves`` (g, pos, h, n), and of the siblings of every node below a top."""
    return f"""{name} AS MATERIALIZED (
  SELECT g, CAST(0 AS BIGINT) AS lv, pos, h, n FROM {leaves}
  UNION ALL
  SELECT g, lv + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM {name} WHERE n > 1 GROUP BY g, lv, pos // 8, n
), {name}_side AS MATERIALIZED (
  SELECT a.g, a.lv, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM {name} a JOIN {name} b ON a.g IS NOT DISTINCT FROM b.g AND a.lv = b.lv AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY a.g, a.lv, a.pos
)"""


#: The trees level by level, the siblings on every leaf's way, and the tampered leaves folded up along them.
MANIFEST_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_LEAF.format(text="text")} AS leaf, CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_LEAF.format(text=_LOWER)} END AS other FROM documents
), leaves AS MATERIALIZED (
  SELECT doc_id, lang AS g, leaf AS h, coalesce(other, leaf) AS seen, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d
), {_tree("t", "leaves")}, subs AS MATERIALIZED (
  SELECT 0 AS g, g AS lang, h, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1
), {_tree("u", "subs")}, way AS (
  SELECT doc_id, g, pos, seen AS node, '' AS proof, CAST(0 AS BIGINT) AS lv, 0 AS tree, n, pos AS leaf_pos FROM leaves
  UNION ALL
  SELECT w.doc_id, w.g, CASE WHEN w.n > 1 THEN w.pos // 8 ELSE s.pos END, CASE WHEN w.n > 1 THEN sha256(coalesce(x.l, y.l) || w.node || coalesce(x.r, y.r)) ELSE w.node END,
    CASE WHEN w.n > 1 THEN w.proof || coalesce(x.l, y.l) || coalesce(x.r, y.r) ELSE w.proof END,
    CASE WHEN w.n > 1 THEN w.lv + 1 ELSE 0 END, CASE WHEN w.n > 1 THEN w.tree ELSE 1 END, CASE WHEN w.n > 1 THEN (w.n + 7) // 8 ELSE s.n END, w.leaf_pos
  FROM way w LEFT JOIN t_side x ON w.tree = 0 AND w.g IS NOT DISTINCT FROM x.g AND w.lv = x.lv AND w.pos = x.pos
    LEFT JOIN u_side y ON w.tree = 1 AND w.lv = y.lv AND w.pos = y.pos
    LEFT JOIN subs s ON w.tree = 0 AND w.n = 1 AND w.g IS NOT DISTINCT FROM s.lang
  WHERE w.n > 1 OR w.tree = 0
)
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, r.h AS root, sha256(w.proof) AS proof_sha256, w.node AS folded_root, w.node = r.h AS verified
FROM leaves l JOIN way w ON w.tree = 1 AND w.n = 1 AND w.g IS NOT DISTINCT FROM l.g AND w.leaf_pos = l.pos
JOIN subs s ON s.lang IS NOT DISTINCT FROM l.g JOIN u r ON r.n = 1
"""


#: The shortest path from the last row back to the first, over all ways to edit a row in every grammar state.
REPAIR_SQL = rf"""
WITH RECURSIVE base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fate
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM base WHERE fate <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text), copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, left(role, 1) AS r
  FROM damaged
), rows_ AS MATERIALIZED (
  SELECT *, CASE WHEN regexp_full_match(text, '[ 	-
]*') THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' ELSE '' END AS fault,
         lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS pair
  FROM placed
), moves(a, r, b) AS (
  VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), inserted(a, b, c, l) AS (
  VALUES (0, 0, 0, ''), (0, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 1, 0, ''), (1, 2, 5, 'I'), (1, 3, 10, 'II'), (2, 2, 0, ''), (2, 3, 5, 'I'), (3, 3, 0, ''), (3, 2, 5, 'I')
), edits AS MATERIALIZED (
  SELECT conv_id, i, z.a, z.a AS b, 2 AS c, 'D' AS l FROM rows_, (VALUES (0), (1), (2), (3)) z(a)
  UNION ALL
  SELECT conv_id, i, a, b, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END, 'K' FROM rows_ JOIN moves USING (r) WHERE fault IN ('', 'truncated')
  UNION ALL
  SELECT conv_id, i, a, b, CASE WHEN fault = 'truncated' THEN 6 ELSE 1 END, 'R' FROM rows_, moves WHERE moves.r <> 's' AND fault IN ('', 'truncated')
), arcs AS MATERIALIZED (
  SELECT conv_id, i, n.a, e.b, min({{'c': n.c + e.c, 'l': n.l || e.l}}) AS w FROM inserted n JOIN edits e ON n.b = e.a GROUP BY conv_id, i, n.a, e.b
), walk AS (
  SELECT conv_id, max(i) + 1 AS i, z.s, {{'c': z.c, 'l': z.l}} AS w FROM rows_, (VALUES (0, 0, ''), (1, 10, 'II'), (2, 5, 'I'), (3, 0, '')) z(s, c, l) GROUP BY conv_id, z.s, z.c, z.l
  UNION ALL
  SELECT k.conv_id, arcs.i, arcs.a, min({{'c': arcs.w.c + k.w.c, 'l': arcs.w.l || k.w.l}}) FROM walk k JOIN arcs ON k.conv_id IS NOT DISTINCT FROM arcs.conv_id AND arcs.i = k.i - 1 AND arcs.b = k.s
  GROUP BY k.conv_id, arcs.i, arcs.a
), best AS MATERIALIZED (
  SELECT conv_id, w.c AS cost, w.l AS audit FROM walk WHERE i = 1 AND s = 0
), labels AS (
  SELECT conv_id, unnest(string_split(audit, '')) AS e, unnest(range(length(audit))) AS o FROM best
), counted AS (
  SELECT conv_id, e, o, sum(CASE WHEN e <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY o) AS i FROM labels
), kept AS (
  SELECT c.conv_id, c.o, c.e, x.role, x.text, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.o) AS j,
         CASE WHEN first_value(c.e) OVER (PARTITION BY c.conv_id ORDER BY c.o) = 'K' AND first_value(x.r) OVER (PARTITION BY c.conv_id ORDER BY c.o) = 's' THEN 1 ELSE 0 END AS headed
  FROM counted c LEFT JOIN rows_ x ON c.e <> 'I' AND c.conv_id IS NOT DISTINCT FROM x.conv_id AND c.i = x.i WHERE c.e <> 'D'
), lines AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (j - headed) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY o)) AS sha FROM kept GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows_ GROUP BY conv_id
)
SELECT v.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) v LEFT JOIN counts c ON v.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON v.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN lines l ON v.conv_id IS NOT DISTINCT FROM l.conv_id
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return {"op1_uniform_threshold": TOPK_SQL, "op7_cuckoo_dedup": DEDUP_SQL, "op10_odd_sketch_dedup": NEAR_SQL, "op11_block_manifest": MANIFEST_SQL, "op13_composed_repair": REPAIR_SQL}
