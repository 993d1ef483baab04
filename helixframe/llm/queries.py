"""One query for each corpus operator over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import bpe_stream, decontam_lsa, piece_table, quality_cascade, rff_quality, secret_novelty, simhash, simple8b, token_alignment, token_counts, tool_calls, url_lists, warc_derive

LIMIT = 4096


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)


#: Schemas of the tools in the calls that op2 derives from chat turns.
TOOLS = {
    "search": {"type": "object", "required": ["query", "turn"], "additionalProperties": False, "properties": {"query": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}, "size": {"type": "number", "maximum": 400}}},
    "fetch": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string", "maxLength": 300}, "turn": {"type": "integer"}}},
}


def chat_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """User turns as calls after the call two turns before (turn 6 also after turn 0), assistant turns as results of the turn before.

    Ids count within a conversation, so a null conv_id is one of its own; a
    call without a turn keeps its row, after no call and without results.
    """
    size = F.length("text")
    call = F.concat_ws(":", "conv_id", "turn")
    at = lambda back: F.when(F.col("turn").isNotNull(), F.concat_ws(":", "conv_id", (F.col("turn") - back).cast("string")))
    name = F.when(size % 10 == 0, "browse").when(size % 2 == 0, "search").otherwise("fetch")
    args = F.to_json(F.struct(F.col("text").alias("query"), F.col("turn").alias("turn"), size.cast("double").alias("size")))
    calls = turns.filter("role = 'user'").select("conv_id", call.alias("call_id"), name.alias("name"), args.alias("arguments"), F.when(F.col("turn") == 6, F.array(at(2), at(6))).otherwise(F.array(at(2))).alias("after"))
    results = turns.filter("role = 'assistant'").select("conv_id", at(1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op2_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat_calls(_table(spark, sf_dir, "conversations"))
    linked = tool_calls.link_tool_calls(calls, results, TOOLS)
    none = lambda kind: F.lit(None).cast(kind)
    orphans = tool_calls.orphan_results(calls, results).select(
        "call_id", "conv_id", none("string").alias("name"), none("long").alias("position"), F.lit(1).cast("long").alias("n_results"), F.lit("orphan").alias("status"),
        F.array().cast("array<string>").alias("problems"), none("string").alias("json"), F.lit(0).cast("long").alias("n_calls"), tool_calls.content_number("content").alias("results_sum"), F.array("content").alias("results"),
    )
    return linked.unionByName(orphans).select("conv_id", "call_id", "name", "position", "status", "n_results", F.size("problems").cast("long").alias("n_problems"), F.sha2("json", 256).alias("json_sha256"), "n_calls", "results_sum", F.sha2(F.to_json("results"), 256).alias("results_sha256"))


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    date = F.date_format(F.timestamp_seconds(F.lit(1577836800) + F.col("page_id") * 3607), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    header = F.format_string("Content-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\nX-Page: %d", F.octet_length("html"), "page_id")
    records = warc_derive.derive_records(pages.withColumns({"date": date, "headers": header}), date_col="date", headers_col="headers")
    return records.select("page_id", "record_type", "record_id", "refers_to", "payload_digest", "block_digest", F.octet_length("block").cast("long").alias("n_bytes"), F.sha2(F.concat("header", F.lit("\r\n\r\n"), "block"), 256).alias("record_sha256"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam_lsa.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_cascade.cascade(_table(spark, sf_dir, "documents"), features=True)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept")


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.digests(bpe_stream.encode_round_trip(_table(spark, sf_dir, "documents")))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.ids_through_files(_table(spark, sf_dir, "documents"))


def dated_lists(captures: DataFrame) -> DataFrame:
    """Three dated entries for each host and parent domain of the captures; dates and actions come from the name's md5."""
    names = captures.select(F.explode(url_lists.with_parents(url_lists.host_of(F.col("url")))).alias("pattern")).distinct()
    h = F.conv(F.substring(F.md5("pattern"), 1, 6), 16, 10).cast("int")
    start = F.to_date(F.lit("2020-01-01"))
    made = F.array(
        F.struct(F.when(h % 3 == 0, "allow").otherwise("block").alias("action"), F.date_add(start, (h % 400).cast("int")).alias("listed_on")),
        F.struct(F.lit("remove").alias("action"), F.date_add(start, (400 + h % 300).cast("int")).alias("listed_on")),
        F.struct(F.when(h % 5 < 2, "allow").otherwise("block").alias("action"), F.date_add(start, (700 + h % 500).cast("int")).alias("listed_on")),
    )
    return names.select("pattern", F.inline(made))


def op9_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_add(F.to_date(F.lit("2020-01-01")), F.pmod("page_id", F.lit(1461)).cast("int"))
    captures = _table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched_on"))
    return url_lists.filter_captures(captures, dated_lists(captures))


def op10_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_novelty.digests(secret_novelty.scan_secrets(_table(spark, sf_dir, "documents")))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_table.digests(_table(spark, sf_dir, "documents"))


def op12_rff_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rff_quality.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_documents(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_tool_call_linking, op3_warc_derivatives, op4_benchmark_decontamination, op5_quality_cascade, op6_bpe_round_trip, op7_simhash, op8_simple8b, op9_url_lists, op10_secret_novelty, op11_fill_in_middle, op12_rff_quality, op13_token_alignment, pipeline)}

ORACLES = {
    "op2_tool_call_linking": r"""
WITH RECURSIVE u AS (SELECT conv_id, turn, text, length(text) AS n FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn - 1 AS turn, text AS content FROM conversations WHERE role = 'assistant'),
edges AS (SELECT x.conv_id, x.turn, y.turn AS before FROM u x JOIN u y ON x.conv_id = y.conv_id AND (y.turn = x.turn - 2 OR x.turn = 6 AND y.turn = 0)),
ways AS (SELECT conv_id, turn, 0 AS steps FROM u UNION ALL SELECT e.conv_id, e.turn, w.steps + 1 FROM ways w JOIN edges e ON e.conv_id = w.conv_id AND e.before = w.turn),
places AS (SELECT conv_id, turn, max(steps) AS position FROM ways GROUP BY 1, 2),
answers AS (SELECT conv_id, turn, count(*) AS n_results, min(content) AS content, sum(CAST('0x' || md5(content)[1:8] AS BIGINT)) AS results_sum, list_sort(list(content)) AS results FROM a GROUP BY 1, 2),
calls AS (SELECT u.*, CAST(position AS BIGINT) AS position, CASE WHEN n % 10 = 0 THEN 'browse' WHEN n % 2 = 0 THEN 'search' ELSE 'fetch' END AS name,
                 coalesce(n_results, 0) AS n_results, content, CAST(coalesce(results_sum, 0) AS BIGINT) AS results_sum, coalesce(results, []) AS results, u.conv_id || ':' || u.turn AS call_id
          FROM u JOIN places p ON u.conv_id = p.conv_id AND u.turn = p.turn LEFT JOIN answers r ON u.conv_id = r.conv_id AND u.turn = r.turn),
judged AS (SELECT *, CAST(CASE name WHEN 'search' THEN (n > 400)::INT + (n < 1)::INT WHEN 'fetch' THEN (n > 300)::INT ELSE 0 END AS BIGINT) AS n_problems FROM calls)
SELECT conv_id, call_id, name, position, CASE WHEN name = 'browse' THEN 'unknown_tool' WHEN n_problems > 0 THEN 'invalid' WHEN n_results = 0 THEN 'no_result' ELSE 'ok' END AS status, n_results, n_problems,
       sha256('{"arguments":{"query":' || to_json(text) || ',"size":' || n || ',"turn":' || turn || '},"call_id":"' || call_id || '","name":"' || name || '","position":' || position || ',"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}') AS json_sha256,
       CAST(1 AS BIGINT) AS n_calls, results_sum, sha256(CAST(to_json(results) AS VARCHAR)) AS results_sha256
FROM judged
UNION ALL SELECT a.conv_id, a.conv_id || ':' || a.turn, NULL, NULL, 'orphan', 1, 0, NULL, 0, CAST('0x' || md5(content)[1:8] AS BIGINT), sha256(CAST(to_json([content]) AS VARCHAR)) FROM a ANTI JOIN u ON a.conv_id = u.conv_id AND a.turn = u.turn""",
    "op5_quality_cascade": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w),
g AS (SELECT doc_id, pos, CASE WHEN lead(word, 2) OVER o IS NOT NULL THEN word || chr(10) || lead(word) OVER o || chr(10) || lead(word, 2) OVER o END AS gram
      FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, pos, gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 AS again FROM g),
c AS (SELECT doc_id, again OR coalesce(lag(again) OVER o, false) OR coalesce(lag(again, 2) OVER o, false) AS hit
      FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
n AS (SELECT doc_id, count(*) FILTER (WHERE hit) AS n_repeat_words FROM c GROUP BY doc_id),
f AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines
      FROM w LEFT JOIN n ON w.doc_id = n.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * word_chars OR 10 * n_dup_lines > 7 * n_lines OR word_chars > 40 * n_words OR 2 * word_chars < 3 * n_words) AS kept
FROM b""",
    "op9_url_lists": r"""
WITH pages_u AS (SELECT page_id, lower(regexp_replace(url, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')) AS u,
                        DATE '2020-01-01' + CAST(((page_id % 1461) + 1461) % 1461 AS INTEGER) AS fetched_on FROM pages),
pages_a AS (SELECT page_id, fetched_on, CASE WHEN regexp_matches(u, '^([a-z][a-z0-9+.-]*:)?//') THEN regexp_extract(u, '^(?:[a-z][a-z0-9+.-]*:)?//([^/?#\\]*)', 1) ELSE regexp_extract(u, '^([^/?#\\:@\s]+\.[^/?#\\:@\s]+(?::[0-9]*)?)(?:[/?#\\]|$)', 1) END AS auth FROM pages_u),
pages_h AS (SELECT page_id, fetched_on, nullif(rtrim(regexp_replace(string_split(auth, '@')[-1], ':[0-9]*$', ''), '.'), '') AS host FROM pages_a),
hosts AS (SELECT DISTINCT host, CASE WHEN host LIKE '[%' OR regexp_matches(host, '^[0-9]+(\.[0-9]+){3}$') THEN [host] ELSE string_split(host, '.') END AS labels FROM pages_h WHERE host IS NOT NULL),
keys AS (SELECT host, unnest(list_transform(range(1, greatest(len(labels) - 1, 1) + 1), lambda i: array_to_string(list_slice(labels, i, len(labels)), '.'))) AS pattern FROM hosts),
names AS (SELECT DISTINCT pattern, CAST('0x' || substr(md5(pattern), 1, 6) AS INTEGER) AS h FROM keys),
entries AS (
  SELECT pattern, CASE WHEN h % 3 = 0 THEN 'allow' ELSE 'block' END AS action, DATE '2020-01-01' + h % 400 AS valid_from FROM names
  UNION ALL SELECT pattern, 'remove', DATE '2020-01-01' + (400 + h % 300) FROM names
  UNION ALL SELECT pattern, CASE WHEN h % 5 < 2 THEN 'allow' ELSE 'block' END, DATE '2020-01-01' + (700 + h % 500) FROM names),
spans AS (SELECT *, lead(valid_from) OVER (PARTITION BY pattern ORDER BY valid_from) AS valid_to FROM entries),
hits AS (SELECT p.page_id, k.pattern, s.action, s.valid_from, row_number() OVER (PARTITION BY p.page_id ORDER BY length(k.pattern) DESC) AS rn
         FROM pages_h p JOIN keys k ON p.host = k.host JOIN spans s ON s.pattern = k.pattern AND s.action <> 'remove'
          AND p.fetched_on >= s.valid_from AND (s.valid_to IS NULL OR p.fetched_on < s.valid_to))
SELECT p.page_id, p.host, p.fetched_on, coalesce(h.action, 'none') AS verdict, h.pattern, h.valid_from AS since
FROM pages_h p LEFT JOIN hits h ON p.page_id = h.page_id AND h.rn = 1""",
    "op11_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT doc_id, t, units, CAST(len(units) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS k1, CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS k2,
             t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain, CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 AS spm FROM d),
p AS (SELECT *, array_to_string(units[1:least(k1, k2)], '') AS prefix, array_to_string(units[least(k1, k2) + 1:greatest(k1, k2)], '') AS middle, array_to_string(units[greatest(k1, k2) + 1:], '') AS suffix FROM k)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form, CASE WHEN NOT plain THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN NOT plain THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE WHEN plain THEN t WHEN spm THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p""",
}
