"""The standing queries of the training-data operators, and the SQL of those that SQL can express.

Each applies its operator to its whole table and derives the columns its
contract names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, embeddings, filteraudit, fingerprints, langid, licenses, mixing, quality, sharding, simhash, toxicity, urlfilter

SHARDS = [f"shard-{i:03d}" for i in range(64)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(_table(spark, sf_dir, "documents"), emit=("ids_sha256", "decoded_sha256")).withColumnRenamed("id", "doc_id")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents").select("doc_id"), SHARDS)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit_languages(docs.where(~held_out(F.col("doc_id"))))
    return langid.predict_languages(docs, model).select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_groups(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit_severity(docs, "doc_id", "text", "toxic", grades=_table(spark, sf_dir, "labels"))
    return toxicity.score_severity(docs, model).withColumnRenamed("id", "doc_id")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return conversations.repair_conversations(conversations.damage(rows), rows, "copies")


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.document_fingerprints(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op13 that SQL can express."""
    return op13_document_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def quality_base_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of op7 that SQL can express."""
    return op7_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes and targets of op8, a row a document."""
    return op8_source_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_simhash_near_dedup, op2_bpe_trie, op3_license_scan, op4_sharding, op5_language_id, op6_embedding_near_dedup, op7_quality_rules, op8_source_mixing, op9_toxicity, op10_url_filter, op11_conversation_repair, op12_filter_interaction_audit, op13_document_fingerprints, quality_base_figures, mixing_targets, fingerprint_edits)}


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

EMBEDDINGS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT x.vec_id, p.b FROM reach x JOIN pairs p ON x.r = p.a
), parts AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id),
links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT t.vec_id, coalesce(n, 0) AS n_links, component_id, t.vec_id = component_id AS kept
FROM embeddings t LEFT JOIN parts p ON t.vec_id = p.vec_id LEFT JOIN links l ON t.vec_id = l.a
"""

QUALITY_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d WHERE len(w) > 2),
windows AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM places),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(dup.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
  len(w) < 50 OR 100 * coalesce(covered.n, 0) > 50 * len(w) AS base_failed
FROM d LEFT JOIN dup ON d.doc_id = dup.doc_id LEFT JOIN covered ON d.doc_id = covered.doc_id
"""

#: Water-filling: for each number of capped sources, in the order of cap a weight, the level of the others; the first that no other exceeds holds.
MIXING_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 2.0 * source_size AS cap, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS DOUBLE) AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source IS NULL, source) - 1 AS r FROM w),
levels AS (SELECT k.r AS n, (1.5 * (SELECT sum(source_size) FROM o) - coalesce(sum(o.cap) FILTER (o.r < k.r), 0)) / sum(o.weight) FILTER (o.r >= k.r) AS level FROM o CROSS JOIN (SELECT r FROM o) k GROUP BY k.r),
fits AS (SELECT min(n) AS n FROM levels WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.r >= n AND level * o.weight > o.cap)),
goals AS (SELECT source, source_size, CASE WHEN r < fits.n OR fits.n IS NULL THEN cap ELSE least(cap, level * weight) END AS target FROM o CROSS JOIN fits LEFT JOIN levels ON levels.n = fits.n)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, round(target, 3) AS target FROM d JOIN goals ON d.source IS NOT DISTINCT FROM goals.source
"""


#: All edits turn by turn: up to two inserts, then a deletion, a keep or a rerole; of equal costs the least audit.
REPAIR_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)
), c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS said,
    xor(list_reduce(list_transform(string_split(concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')), ''), lambda x: CAST(ord(x) AS BIGINT)), lambda h, b: xor(h >> 8, t[1 + (xor(h, b) & 255)]), 4294967295), 4294967295) % 20 AS fate
  FROM conversations, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(said, '[.!?]', '', 'g') ELSE said END AS said,
    unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy FROM c WHERE fate <> 0
), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, substr(sha256(said), 1, 32), copy) AS n FROM damaged),
f AS (
  SELECT *, NOT regexp_matches(said, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, said ORDER BY n) > 1 AS again,
    NOT regexp_matches(said, '[.!?][\x20\x09-\x0D]*$') AS cut, substr(role, 1, 1) AS r, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS was FROM o
), ins AS (SELECT * FROM (VALUES ('E', 0, 'E', ''), ('E', 1, 'U', ' user:'), ('E', 2, 'A', ' user: assistant:'), ('S', 0, 'S', ''), ('S', 1, 'U', ' user:'), ('S', 2, 'A', ' user: assistant:'),
  ('U', 0, 'U', ''), ('U', 1, 'A', ' assistant:'), ('U', 2, 'U', ' assistant: user:'), ('A', 0, 'A', ''), ('A', 1, 'U', ' user:'), ('A', 2, 'A', ' user: assistant:')) v(x, k, y, lines)
), acts AS (SELECT * FROM (VALUES ('E', 'D', 'E', NULL, 3), ('S', 'D', 'S', NULL, 3), ('U', 'D', 'U', NULL, 3), ('A', 'D', 'A', NULL, 3),
  ('E', 'K', 'S', 's', 0), ('E', 'K', 'U', 'u', 0), ('S', 'K', 'U', 'u', 0), ('A', 'K', 'U', 'u', 0), ('U', 'K', 'A', 'a', 0),
  ('E', 'R', 'U', NULL, 2), ('S', 'R', 'U', NULL, 2), ('A', 'R', 'U', NULL, 2), ('U', 'R', 'A', NULL, 2)) v(y, edit, z, needs, price)
), rec AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, 'E' AS state, {'c': CAST(0 AS BIGINT), 'a': '', 't': ''} AS best FROM f
  UNION ALL
  SELECT rec.conv_id, f.n, z, min({'c': CAST(best.c + 2 * k + price + CASE WHEN cut AND edit <> 'D' THEN 1 ELSE 0 END AS BIGINT), 'a': concat(best.a, repeat('I', k), edit),
    't': concat(best.t, replace(lines, ' ', chr(10)), CASE edit WHEN 'D' THEN '' WHEN 'K' THEN concat(chr(10), role, ':', said) ELSE concat(chr(10), CASE z WHEN 'U' THEN 'user' ELSE 'assistant' END, ':', said) END)})
  FROM rec JOIN f ON rec.conv_id IS NOT DISTINCT FROM f.conv_id AND f.n = rec.n + 1 JOIN ins ON ins.x = rec.state JOIN acts ON acts.y = ins.y
  WHERE edit = 'D' OR NOT blank AND NOT again AND (needs IS NULL OR needs = r)
  GROUP BY rec.conv_id, f.n, z
), facts AS (
  SELECT conv_id, max(n) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (cut AND NOT blank AND NOT again) AS truncated, count(*) FILTER (was IS NOT NULL AND concat(was, r) NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
), ends AS (
  SELECT rec.conv_id, min({'c': CAST(best.c + 2 * k AS BIGINT), 'a': concat(best.a, repeat('I', k)), 't': concat(best.t, replace(lines, ' ', chr(10)))}) AS best
  FROM rec JOIN facts ON rec.conv_id IS NOT DISTINCT FROM facts.conv_id AND rec.n = facts.n JOIN ins ON ins.x = rec.state WHERE ins.y IN ('E', 'A') GROUP BY rec.conv_id
), every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT every.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(substr(coalesce(best.t, ''), 2)) AS repaired_sha256
FROM every LEFT JOIN facts ON every.conv_id IS NOT DISTINCT FROM facts.conv_id LEFT JOIN ends ON every.conv_id IS NOT DISTINCT FROM ends.conv_id
"""

#: Every document under every order, step by step.
AUDIT_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {WORDS} AS words FROM documents),
d AS (
  SELECT part, coalesce(bool_or(l.quality = 1), FALSE) AS good, coalesce(bool_or(l.toxic = 1), FALSE) AS toxic,
    [len(any_value(words)) < 200, 100 * len(list_distinct(any_value(words))) < 50 * len(any_value(words)), 100 * length(regexp_replace(any_value(text), '[^A-Z]', '', 'g')) > 3 * length(any_value(text)),
     regexp_matches(any_value(text), '[#$%&*|]'), coalesce(w.doc_id > any_value(least_id), FALSE)] AS fails
  FROM (SELECT *, row_number() OVER () AS row, min(doc_id) OVER (PARTITION BY text) AS least_id FROM w) w LEFT JOIN labels l ON w.doc_id = l.doc_id GROUP BY row, part, w.doc_id
), orders AS (SELECT '' AS o UNION ALL SELECT concat(o, x) FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(o, x)),
steps AS (
  SELECT part, good, toxic, o, s, fails[strpos('ABCDE', o[s])] AS here, len(list_filter([1, 2, 3, 4, 5], lambda k: k < s AND fails[strpos('ABCDE', o[k])])) AS earlier, len(list_filter(fails, lambda x: x)) AS failed
  FROM d, (SELECT o FROM orders WHERE length(o) = 5), (SELECT unnest([1, 2, 3, 4, 5]) AS s)
), sums AS (
  SELECT part, o AS filter_order, s AS step, count(*) FILTER (NOT here AND earlier = 0) AS kept, count(*) FILTER (here AND earlier = 0) AS removed, count(*) FILTER (here AND earlier > 0) AS redundant,
    count(*) FILTER (here AND failed = 1) AS unique_fails, count(*) FILTER (here AND earlier = 0 AND good) AS good_lost, count(*) FILTER (here AND earlier = 0 AND toxic) AS toxic_lost FROM steps GROUP BY part, o, s
)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley FROM sums
"""

EDITS_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS after, length(text) // 2 AS half FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST))
SELECT doc_id, length(text) AS n_chars, sha256(concat(left(text, length(text) - half), CASE WHEN half = 0 THEN '' ELSE left(after, half) END)) AS edited_sha256 FROM n
"""


def _sharding_sql() -> str:
    table = ",".join(map(str, sharding.fill_table(SHARDS).tolist()))
    return f"""
WITH t AS (SELECT [{table}] AS slots),
d AS (SELECT doc_id, CAST(CAST(concat('0x', substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) % {sharding.SLOTS} AS INTEGER) AS slot FROM documents)
SELECT doc_id, slot, CAST(slots[slot + 1] AS INTEGER) AS shard FROM d, t
"""


def _urls_sql() -> str:
    """Rules, and components over canonical links and refreshes whose targets are absolute or begin at the root."""
    fits = lambda host, path: " ".join(f"WHEN ({host} = '{own}' OR ends_with({host}, '.{own}')) AND starts_with({path}, '/{rest}') THEN '{v} {rule}'" for v, rule in sorted(urlfilter.RULES, key=lambda r: -len(r[1])) for own, _, rest in [rule.partition("/")])
    part = lambda url: f"translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract({url}, '(?s)^[^?#]*(\\?[^#]*)', 1) AS query"
    node = "CASE WHEN host <> '' THEN concat(host, CASE WHEN path = '' THEN '/' ELSE path END, query) END AS node"
    return f"""
WITH RECURSIVE p AS (SELECT page_id, url, html, {part("coalesce(url, '')")} FROM pages),
q AS (SELECT *, {node}, CASE {fits("host", "path")} END AS hit FROM p),
tags AS (SELECT node, url, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<(?:link|meta)\\s(?:[^>=]|=+\\s*(?:"[^"]*"|''[^'']*'')?)*>')) AS tag FROM q WHERE node IS NOT NULL AND regexp_matches(html, '(?i)canonical|refresh')),
raw AS (SELECT node, url, replace(CASE WHEN regexp_matches(tag, '(?is)^<link.*\\srel\\s*=\\s*["'']?canonical') THEN regexp_extract(tag, '(?is)\\shref\\s*=\\s*["'']?([^"''\\s>]+)', 1) WHEN regexp_matches(tag, '(?is)^<meta.*http-equiv\\s*=\\s*["'']?refresh') THEN regexp_extract(tag, '(?is)url\\s*=\\s*([^"''\\s>]+)', 1) ELSE '' END, '&amp;', '&') AS link FROM tags),
goal AS (SELECT node AS a, CASE WHEN link LIKE '%://%' THEN link WHEN starts_with(link, '/') THEN concat(regexp_extract(url, '^[^:]+://[^/?#]*'), link) END AS link FROM raw WHERE link <> ''),
met AS (SELECT a, {part("link")} FROM goal WHERE link IS NOT NULL),
edges AS (SELECT a, node AS b FROM (SELECT a, {node} FROM met) WHERE node IS NOT NULL),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a AS node, a AS r FROM both_ways UNION SELECT x.node, e.b FROM reach x JOIN both_ways e ON x.r = e.a),
said AS (SELECT node, CASE {fits("split_part(r, '/', 1)", "regexp_extract(r, '^[^/]*([^?]*)', 1)")} END AS hit FROM reach),
whole AS (SELECT node, bool_or(starts_with(coalesce(hit, ''), 'block')) AND NOT bool_or(starts_with(coalesce(hit, ''), 'allow')) AS blocked FROM said GROUP BY node)
SELECT page_id, host, path, split_part(hit, ' ', 2) AS rule, CASE WHEN hit IS NOT NULL THEN split_part(hit, ' ', 1) WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
FROM q LEFT JOIN whole ON q.node = whole.node
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_sharding": _sharding_sql(), "op6_embedding_near_dedup": EMBEDDINGS_SQL, "op10_url_filter": _urls_sql(), "op11_conversation_repair": REPAIR_SQL, "op12_filter_interaction_audit": AUDIT_SQL, "fingerprint_edits": EDITS_SQL, "quality_base_figures": QUALITY_SQL, "mixing_targets": MIXING_SQL}
