"""One query for each operator, with production parameters over whole tables, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, contamination, conversations, counts, language, lexical, personal, quality, secrets, simhash, tokenfile, toxicity, warc
from .store import staged, table


def vocabulary(name: str) -> Callable[[], str]:
    """Where a public vocabulary lies on the machine that asks."""

    def path() -> str:
        import public_tokenizers

        return public_tokenizers.path(name)

    return path


def pattern() -> str:
    """The public pattern that cuts text before the merges of rank files."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language.is_held_out())
    return language.identify(docs, language.models(docs.filter("NOT held_out")), ["doc_id", "held_out"])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    measured = staged(quality.measured(docs, ["doc_id", "lang"]), "measures")  # texts are read once and never shuffled
    judgement = labels.filter("quality IS NOT NULL").groupBy("doc_id").agg((F.max("quality") == 1).alias("good"))
    fit = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    cutoffs = staged(quality.joint_cutoffs(measured.join(judgement, "doc_id"), F.col("good"), fit, F.col("lang")), "cutoffs")
    return quality.judged(measured, cutoffs, F.col("lang"), ["doc_id"])


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", simhash.hex_print().alias("fingerprint"), F.col("__component").alias("component_id"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    items = F.sha2(F.array_join(F.array_sort("__items"), ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("__items").cast("long").alias("n_items"), items.alias("items_sha256"), "contaminated")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan_secrets(table(spark, sf_dir, "documents"), ["doc_id"]), ["doc_id"])


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.digests(personal.scan_personal(table(spark, sf_dir, "documents"), ["doc_id"]), ["doc_id"])


def op7_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), pattern(), ["doc_id"], ["n_tokens", "ids_sha256", "decoded_sha256"])


def op8_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.read_tokens(tokenfile.write_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), ["doc_id"])


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", toxicity.is_held_out())
    weights = toxicity.fit(docs.filter("NOT held_out"), table(spark, sf_dir, "labels").filter(~toxicity.is_held_out()))
    return toxicity.score(docs, weights, ["doc_id", "held_out"])


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.repair_report(conversations.damaged(rows), rows)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_quality_rules, op3_simhash_dedup, op4_decontamination, op5_secret_scan, op6_personal_data, op7_bpe_roundtrip, op8_warc_archive, op9_token_files, op10_token_counts, op11_lexical_search, op12_toxicity, op13_conversation_repair)}

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op4_decontamination": rf"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '{_WORDS}') AS w FROM benchmark
), item_window AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i + 1 : i + 13], ' ') AS win
  FROM item, unnest(range(greatest(len(w) - 12, 1))) AS r(i) WHERE len(w) > 0
), doc AS (
  SELECT doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '{_WORDS}') AS w FROM documents
), size AS (
  SELECT DISTINCT size FROM item_window
), doc_window AS (
  SELECT doc_id, size, i, array_to_string(w[i + 1 : i + size], ' ') AS win
  FROM doc, size, unnest(range(len(w) - size + 1)) AS r(i) WHERE len(w) >= size
), found AS (
  SELECT d.doc_id, d.i, d.size, b.item_id FROM doc_window d JOIN item_window b ON d.size = b.size AND d.win = b.win
), hit AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM found, unnest(range(size)) AS r(j) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM found GROUP BY doc_id
)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit ON hit.doc_id = doc.doc_id LEFT JOIN items ON items.doc_id = doc.doc_id
""",
    "op8_warc_archive": """
WITH page AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), keeper AS (
  SELECT page_id, payload_bytes, hex, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS kept FROM page
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, 1 + 5 * CAST(i // 4 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = kept THEN NULL ELSE kept END AS refers_to
FROM keeper
""",
    "op11_lexical_search": rf"""
WITH doc AS (
  SELECT row_number() OVER () AS d, doc_id, unnest(regexp_extract_all({_ASCII_LOWER.format("text")}, '{_WORDS}')) AS term FROM documents
), posting AS (
  SELECT d, doc_id, term, count(*) AS tf, sum(count(*)) OVER (PARTITION BY d) AS n FROM doc GROUP BY d, doc_id, term
), size AS (
  SELECT count(DISTINCT d) AS rows, count(*) AS terms FROM doc
), weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * rows + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM posting, size GROUP BY term, rows
), item AS (
  SELECT DISTINCT item_id, i, unnest(regexp_extract_all({_ASCII_LOWER.format("text")}, '{_WORDS}')) AS term FROM (SELECT *, row_number() OVER () AS i FROM benchmark)
), scored AS (
  SELECT item_id, i, d, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + CAST(50 * n * rows AS BIGINT) // terms)))) AS BIGINT) AS score
  FROM item JOIN weight USING (term) JOIN posting USING (term), size GROUP BY item_id, i, d, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
""",
    "op13_conversation_repair": r"""
WITH RECURSIVE filled AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), coded AS (
  SELECT *, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(key, ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, v: xor(xor(a, v) >> 1, (xor(a, v) & 1) * 3988292384)), 4294967295) % 20 AS code FROM filled
), damaged AS (
  SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE code WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM coded WHERE code <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM damaged
), marked AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed
), fault AS (
  SELECT conv_id, turn, role, text, i, blank, again AND NOT blank AS duplicate, cut AND NOT again AND NOT blank AS truncated, blank OR again AS gone,
    before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal FROM marked
), conv AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate,
    count_if(truncated) AS truncated, count_if(illegal) AS illegal,
    list({'role': role, 'text': text, 'h': left(role, 1), 'gone': gone, 'x': CASE WHEN truncated THEN 3 ELSE 0 END} ORDER BY i) AS rows FROM fault GROUP BY conv_id
), walk AS (
  SELECT conv_id, n AS k, rows, {'c': 0, 'a': '', 't': CAST([] AS VARCHAR[])} AS s0, {'c': 6, 'a': 'II', 't': ['user:', 'assistant:']} AS s1,
    {'c': 3, 'a': 'I', 't': ['assistant:']} AS s2, {'c': 0, 'a': '', 't': CAST([] AS VARCHAR[])} AS s3 FROM conv
  UNION ALL
  SELECT conv_id, k - 1, rows,
    list_min([b0, {'c': b2.c + 3, 'a': 'I' || b2.a, 't': list_concat(['user:'], b2.t)}, {'c': b3.c + 6, 'a': 'II' || b3.a, 't': list_concat(['user:', 'assistant:'], b3.t)}]),
    list_min([b1, {'c': b2.c + 3, 'a': 'I' || b2.a, 't': list_concat(['user:'], b2.t)}, {'c': b3.c + 6, 'a': 'II' || b3.a, 't': list_concat(['user:', 'assistant:'], b3.t)}]),
    list_min([b2, {'c': b3.c + 3, 'a': 'I' || b3.a, 't': list_concat(['assistant:'], b3.t)}]),
    list_min([b3, {'c': b2.c + 3, 'a': 'I' || b2.a, 't': list_concat(['user:'], b2.t)}])
  FROM (
    SELECT conv_id, k, rows,
      list_min([{'c': s0.c + 4, 'a': 'D' || s0.a, 't': s0.t}, {'c': CASE WHEN r.gone OR r.h <> 's' THEN 1000000 ELSE s1.c + r.x END, 'a': 'K' || s1.a, 't': list_concat([r.role || ':' || r.text], s1.t)},
        {'c': CASE WHEN r.gone OR r.h <> 'u' THEN 1000000 ELSE s2.c + r.x END, 'a': 'K' || s2.a, 't': list_concat([r.role || ':' || r.text], s2.t)},
        {'c': CASE WHEN r.gone THEN 1000000 ELSE s2.c + r.x + 3 END, 'a': 'R' || s2.a, 't': list_concat(['user:' || r.text], s2.t)}]) AS b0,
      list_min([{'c': s1.c + 4, 'a': 'D' || s1.a, 't': s1.t}, {'c': CASE WHEN r.gone OR r.h <> 'u' THEN 1000000 ELSE s2.c + r.x END, 'a': 'K' || s2.a, 't': list_concat([r.role || ':' || r.text], s2.t)},
        {'c': CASE WHEN r.gone THEN 1000000 ELSE s2.c + r.x + 3 END, 'a': 'R' || s2.a, 't': list_concat(['user:' || r.text], s2.t)}]) AS b1,
      list_min([{'c': s2.c + 4, 'a': 'D' || s2.a, 't': s2.t}, {'c': CASE WHEN r.gone OR r.h <> 'a' THEN 1000000 ELSE s3.c + r.x END, 'a': 'K' || s3.a, 't': list_concat([r.role || ':' || r.text], s3.t)},
        {'c': CASE WHEN r.gone THEN 1000000 ELSE s3.c + r.x + 3 END, 'a': 'R' || s3.a, 't': list_concat(['assistant:' || r.text], s3.t)}]) AS b2,
      list_min([{'c': s3.c + 4, 'a': 'D' || s3.a, 't': s3.t}, {'c': CASE WHEN r.gone OR r.h <> 'u' THEN 1000000 ELSE s2.c + r.x END, 'a': 'K' || s2.a, 't': list_concat([r.role || ':' || r.text], s2.t)},
        {'c': CASE WHEN r.gone THEN 1000000 ELSE s2.c + r.x + 3 END, 'a': 'R' || s2.a, 't': list_concat(['user:' || r.text], s2.t)}]) AS b3
    FROM (SELECT *, rows[k] AS r FROM walk WHERE k > 0)
  )
)
SELECT e.conv_id, CAST(coalesce(c.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(c.blank, 0) AS BIGINT) AS blank, CAST(coalesce(c.duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(c.truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(c.illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(w.s0.c, 0) AS BIGINT) AS cost, coalesce(w.s0.a, '') AS audit, sha256(coalesce(array_to_string(w.s0.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN conv c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN walk w ON w.k = 0 AND w.conv_id IS NOT DISTINCT FROM e.conv_id
""",
}
