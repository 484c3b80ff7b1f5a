"""Queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terramosaic.llm.common import ship
from terramosaic.llm.common import table as read_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return read_table(spark, sf_dir, name)


def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written to bit-plane shards, and read back. Null text: the end id alone; empty table: no row."""
    from terramosaic.llm.token_binary import tokens_round_trip

    return tokens_round_trip(spark, table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every whole text, decoded again. Null text: no id; repeated rows: repeated results."""
    from terramosaic.llm.byte_bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), keep_ids=False)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and license notices in every whole text. Null text: no word, no label."""
    from terramosaic.llm.license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents")).drop("blocks")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every whole text. Null or empty text: no word, not contaminated."""
    from terramosaic.llm.decontamination import find_contamination

    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), details=False).drop("longest_match")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from the rows that are not held out. Null or letterless text: und."""
    from terramosaic.llm.language_id import identify_documents

    return identify_documents(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document. Null, empty and blank texts: fingerprint zero, linked like any other."""
    from terramosaic.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op1_anisotropic_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors of those whose id is divisible by 20. Unusable vectors take no part; a repeated id is one query."""
    from terramosaic.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 100-byte strings removed from every whole text. Null text: empty; rows of one id are later places of one document."""
    from terramosaic.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back. Null role or text: empty; repeated rows are turns of their own."""
    from terramosaic.llm.chat import digests, format_conversations

    text = "\\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.sql("SELECT -7L AS conv_id, t.turn, t.role, t.text FROM VALUES (0L, 'user', :text), (1L, 'assistant', :text) AS t(turn, role, text)", args={"text": text})
    return digests(format_conversations(turns.unionByName(more)))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text: base patterns, and what the tagger adds. Null text: none."""
    from terramosaic.llm.pii import detect

    return detect(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_anisotropic_ann, op2_token_binary, op3_suffix_dedup, op4_chat_format, op5_license_scan, op6_decontamination, op7_language_id, op8_byte_bpe, op9_pii, op10_simhash)}

OP4_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
), steps AS (
  SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text), 'start') || '>' || role AS step,
    replace(replace(replace(text, '\', '\0'), '###', '\1'), '</turn>', '\2') AS body,
    replace(replace(replace(replace(role, '\', '\0'), '###', '\1'), '</turn>', '\2'), ':', '\3') AS name
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(14 + length(name) + length(body)) AS BIGINT) AS formatted_chars,
  bool_and(step IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user'))
    AND last(role ORDER BY turn NULLS FIRST, role, text) IN ('user', 'assistant') AS valid
FROM steps GROUP BY conv_id
"""

_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6_SQL = f"""
WITH dw AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
bw AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS g, least(len(w), 10) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM bw WHERE len(w) > 0)),
spots AS (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS g FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM dw CROSS JOIN (SELECT DISTINCT n FROM iw))),
hits AS (SELECT doc_id, i, spots.n, item_id FROM spots JOIN iw ON iw.g = spots.g),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _op5_sql() -> str:
    from terramosaic.llm.license_scan import PHRASES, TEMPLATES, THRESHOLD

    phrases = ", ".join(f"({p.split()!r}, '{label}')" for p, label in PHRASES.items())
    templates = ", ".join(f"({sorted(set(t.split()))!r}, '{label}')" for t, label in TEMPLATES)
    return f"""
WITH dw AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
phrase AS (SELECT * FROM (VALUES {phrases}) v(p, label)), template AS (SELECT * FROM (VALUES {templates}) v(tokens, label)),
place AS (SELECT doc_id, i - 1 AS pos, label FROM (SELECT doc_id, w, p, label, unnest(range(1, len(w) - len(p) + 2)) AS i FROM dw CROSS JOIN phrase WHERE len(w) >= len(p) AND list_has_all(w, p)) WHERE list_slice(w, i, i + len(p) - 1) = p),
line AS (SELECT doc_id, {_WORDS.format("l")} AS w FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM dw)),
found AS (SELECT doc_id, label, max(share) AS share FROM (SELECT doc_id, label, len(list_intersect(tokens, w)) / len(tokens) AS share FROM line CROSS JOIN template WHERE list_has_any(w, tokens)) WHERE share >= {THRESHOLD} - 1e-9 GROUP BY 1, 2),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM place GROUP BY 1),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM place UNION SELECT doc_id, label FROM found) GROUP BY 1),
best AS (SELECT doc_id, max(share) AS share FROM found GROUP BY 1)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1e0 ELSE coalesce(share, 0e0) END AS score
FROM dw LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN best USING (doc_id)
"""


ORACLE_SQL: dict[str, str] = {"op4_chat_format": OP4_SQL, "op5_license_scan": _op5_sql(), "op6_decontamination": OP6_SQL}
