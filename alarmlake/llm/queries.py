"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alarmlake.llm import best_fit, fp_search, host_rules, line_index, log_bloom, mixing, ppm, pu_quality, spelling, stream_dedup, toxicity, trie_join, warc
from alarmlake.llm.common import held_out, table
from alarmlake.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@_query(
    "op9_stream_dedup",
    """SELECT doc_id, max(doc_id) OVER w keep_id, count(*) OVER w group_size, doc_id = max(doc_id) OVER w kept, sha256(coalesce(text, '')) text_sha256
       FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
)
def op9_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = stream_dedup.exact_dedup(spark, f"{sf_dir.rstrip('/')}/documents.parquet")
    return judged.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


HOST_SQL = r"""WITH words AS (SELECT doc_id, source, coalesce(text, '') body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
  flat AS (SELECT doc_id, unnest(w) word, generate_subscripts(w, 1) p FROM words),
  wins AS (SELECT doc_id, p, lead(p, 4) OVER o last, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) win
    FROM flat WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
  twice AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, win) n FROM wins WHERE last IS NOT NULL),
  hit AS (SELECT DISTINCT doc_id, unnest(range(p, p + 5)) q FROM twice WHERE n > 1),
  rep AS (SELECT doc_id, count(*) n FROM hit GROUP BY doc_id),
  lines AS (SELECT doc_id, unnest(string_split(body, chr(10))) line FROM words),
  dup AS (SELECT doc_id, count(*) n_lines, count(*) - count(DISTINCT line) n_dup FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
  m AS (SELECT d.doc_id, d.source host, len(d.w) n_words, CAST(length(regexp_replace(d.body, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) word_chars,
    CAST(length(regexp_replace(d.body, '[^#*$%&|<>]', '', 'g')) AS BIGINT) n_symbols, coalesce(dup.n_lines, 0) n_lines, coalesce(dup.n_dup, 0) n_dup_lines, coalesce(rep.n, 0) n_repeat_words
    FROM words d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)),
  failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words base_failed FROM m),
  hosts AS (SELECT host, count(*) n, unnest([count(*) FILTER (base_failed), count(*) FILTER (10 * n_symbols > n_words), count(*) FILTER (10 * n_dup_lines > 3 * n_lines)]) f,
    unnest(['base', 'symbols', 'lines']) rule FROM failed WHERE host IS NOT NULL GROUP BY host),
  moments AS (SELECT rule, avg(f / n) m, var_samp(f / n) v FROM hosts GROUP BY rule),
  prior AS (SELECT rule, m, CASE WHEN v > 0 AND v < m * (1 - m) THEN m * (1 - m) / v - 1 ELSE 1 END k FROM moments),
  bad AS (SELECT host, bool_or((f + m * k) / (n + k) > 0.5) rejected FROM hosts JOIN prior USING (rule) GROUP BY host)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(rejected, false) host_rejected,
    NOT base_failed AND NOT coalesce(rejected, false) kept FROM failed LEFT JOIN bad USING (host)"""


@_query("op10_host_rules", HOST_SQL)
def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge_documents(table(spark, sf_dir, "documents")).drop("host")


@_query("op8_trie_join")
def op8_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = trie_join.near_duplicates(table(spark, sf_dir, "documents"))
    return placed.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query(
    "op1_warc",
    """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) n, sha256(coalesce(html, '')) d FROM pages),
       f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END response FROM p)
       SELECT page_id, n payload_bytes, d payload_digest, CASE WHEN response = page_id THEN 'response' ELSE 'revisit' END record_type,
         CASE WHEN response <> page_id THEN response END refers_to FROM f""",
)
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    records = warc.read_archives(spark, path, with_payload=False)
    return records.select(warc.key_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), warc.key_of("refers_to").alias("refers_to"))


# Parameters of the mixture, for the query and the pipeline.
MIX = {"target_entropy": 0.95, "max_repeats": 1.5, "seed": 17}

MIX_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, source, greatest(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')), 1) tokens,
    coalesce('s' || source, 'n') own, CAST('0x' || substr(md5('b17|' || doc_id), 1, 8) AS BIGINT) % 4096 block FROM documents),
  b AS (SELECT own, block, CAST(sum(tokens) AS BIGINT) bt FROM d GROUP BY ALL),
  t AS (SELECT own, CAST(sum(bt) AS BIGINT) tk FROM b GROUP BY own),
  ent AS (SELECT 0 lo, 1000000 hi UNION ALL
    SELECT CASE WHEN good THEN mid ELSE lo END, CASE WHEN good THEN hi ELSE mid END FROM (SELECT lo, hi, (lo + hi) // 2 mid,
      (SELECT ln(sum(pow(tk, ((lo + hi) // 2) / 1e6))) - ((lo + hi) // 2) / 1e6 * sum(pow(tk, ((lo + hi) // 2) / 1e6) * ln(tk)) / sum(pow(tk, ((lo + hi) // 2) / 1e6))
        >= 0.95 * ln(count(*)) - 1e-9 FROM t) good FROM ent WHERE hi - lo > 1)),
  rpt AS (SELECT -1 lo, 1000000 hi UNION ALL
    SELECT CASE WHEN good THEN lo ELSE mid END, CASE WHEN good THEN mid ELSE hi END FROM (SELECT lo, hi, (lo + hi) // 2 mid,
      (SELECT max(pow(tk, ((lo + hi) // 2) / 1e6 - 1)) / min(pow(tk, ((lo + hi) // 2) / 1e6 - 1)) <= 1.5 + 1e-9 FROM t) good FROM rpt WHERE hi - lo > 1)),
  a AS (SELECT greatest(CASE WHEN (SELECT ln(sum(tk)) - sum(tk * ln(tk)) / sum(tk) >= 0.95 * ln(count(*)) FROM t) THEN 1000000 ELSE (SELECT max(lo) FROM ent) END, (SELECT min(hi) FROM rpt)) / 1e6 ex),
  q AS (SELECT own, tk, CAST(floor(pow(tk, ex) / (SELECT min(pow(tk, ex - 1)) FROM t) + 0.1) AS BIGINT) quota FROM t, a),
  p AS (SELECT own, quota // tk passes, quota % tk rest, quota // tk + CAST(quota % tk > 0 AS INT) runs FROM q),
  e AS (SELECT own, block, bt, passes, rest, unnest(range(1, runs + 1)) pass FROM b JOIN p USING (own)),
  o AS (SELECT *, row_number() OVER w block_rank, sum(bt) OVER w - bt before FROM e WINDOW w AS (PARTITION BY own, pass ORDER BY md5('17|' || pass || '|' || block), block ROWS UNBOUNDED PRECEDING)),
  r AS (SELECT *, CASE WHEN pass <= passes THEN bt ELSE least(bt, rest - before) END room FROM o),
  f AS (SELECT d.doc_id, d.source, d.tokens, d.block, r.pass, r.block_rank, md5('17|' || pass || '|' || doc_id) draw_key, room, room < bt partly, d.own FROM d JOIN r ON r.own = d.own AND r.block = d.block WHERE room > 0),
  g AS (SELECT *, sum(tokens) OVER (PARTITION BY own, block, pass ORDER BY draw_key, tokens ROWS UNBOUNDED PRECEDING) upto FROM f)
  SELECT doc_id, source, tokens, block, pass, block_rank, draw_key FROM g WHERE NOT partly OR upto <= room"""


@_query("op4_mixing", MIX_SQL)
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents"), **MIX).withColumnRenamed("key", "doc_id").drop("uid")


LINE_SQL = r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) p FROM documents),
  k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key FROM l),
  o AS (SELECT key, min(doc_id) first FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
  j AS (SELECT k.*, o.first IS NOT NULL AND o.first <> k.doc_id gone FROM k LEFT JOIN o ON o.key = k.key)
  SELECT doc_id, count(*) n_lines, count(*) FILTER (gone) n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) kept_sha256 FROM j GROUP BY doc_id"""


@_query("op7_line_index", LINE_SQL)
def op7_line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_index.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("rest.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@_query("op2_log_bloom")
def op2_log_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_bloom.score_documents(table(spark, sf_dir, "documents"), held_out("doc_id", 7, 2)).withColumnRenamed("id", "doc_id")


@_query("op5_best_fit")
def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = best_fit.pack(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")
    return packed.withColumn("piece", F.col("piece").cast("int"))


@_query("op3_ppm")
def op3_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = ppm.identify(docs, ~held_out("doc_id", 3, 1))
    return found.select(F.col("key").alias("doc_id"), held_out("key", 3, 1).alias("held_out"), "lang_pred", "score")


@_query("op6_pu_quality")
def op6_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = pu_quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out("doc_id", 5, 0))
    return scored.withColumnRenamed("key", "doc_id")


SPELL_SQL = r"""WITH crc AS (SELECT list(v ORDER BY i) t FROM (SELECT i, list_reduce([1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) v FROM (SELECT CAST(unnest(range(256)) AS BIGINT) i))),
  runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') run FROM documents),
  held AS (SELECT doc_id, run, count(*) c, hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) hx FROM runs GROUP BY ALL),
  hashed AS (SELECT run, c, xor(list_reduce(list_transform(range(length(hx) // 2), lambda i: CAST('0x' || substr(hx, CAST(2 * i + 1 AS INT), 2) AS BIGINT)), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]), 4294967295), 4294967295) h FROM held, crc),
  made AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END word, c FROM hashed),
  v AS (SELECT word, CAST(sum(c) AS BIGINT) n FROM made WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
  cut AS (SELECT word, n, unnest(range(length(word))) p FROM v),
  less AS (SELECT DISTINCT word, n, substr(word, 1, CAST(p AS INT)) || substr(word, CAST(p AS INT) + 2) s FROM cut),
  hole AS (SELECT word, n, p, substr(word, 1, CAST(p AS INT)) || '_' || substr(word, CAST(p AS INT) + 2) s FROM cut),
  near AS (SELECT a.word, b.word other, b.n m FROM hole a JOIN hole b ON a.s = b.s AND a.p = b.p AND a.word <> b.word
    UNION ALL SELECT a.word, b.word, b.n FROM less a JOIN v b ON b.word = a.s UNION ALL SELECT b.word, a.word, a.n FROM less a JOIN v b ON b.word = a.s),
  best AS (SELECT word, count(*) n_near, max(m) m FROM near GROUP BY word),
  first AS (SELECT best.word, best.m, min(other) other FROM best JOIN near ON near.word = best.word AND near.m = best.m GROUP BY ALL),
  j AS (SELECT v.word, CASE WHEN m >= 2 * n THEN other END form, n, coalesce(n_near, 0) n_near, CASE WHEN m >= 2 * n THEN m END form_n FROM v LEFT JOIN best USING (word) LEFT JOIN (SELECT word, other FROM first) f USING (word)),
  steps AS (WITH RECURSIVE r AS (SELECT word, word AS spot, 0 AS k FROM j UNION ALL SELECT r.word, j.form, k + 1 FROM r JOIN j ON j.word = r.spot WHERE j.form IS NOT NULL) SELECT word, arg_max(spot, k) root FROM r GROUP BY word)
  SELECT word, form, root, n, n_near, form_n FROM j JOIN steps USING (word)"""


@_query("op11_spelling", SPELL_SQL)
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


SEARCH_SQL = r"""WITH d AS (SELECT doc_id, row_number() OVER () u, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') t FROM documents),
  i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) term FROM benchmark),
  c AS (SELECT count(*) docs, CAST(sum(len(t)) AS BIGINT) total FROM d WHERE len(t) > 0),
  f AS (SELECT u, doc_id, CAST(n AS BIGINT) n, term, count(*) tf FROM (SELECT u, doc_id, len(t) n, unnest(t) term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
  w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) w FROM f, c GROUP BY term, docs),
  g AS (SELECT u, doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total)) v FROM f, c),
  s AS (SELECT item_id, u, doc_id, CAST(sum(w * v) AS BIGINT) score FROM i JOIN g USING (term) JOIN w USING (term) GROUP BY ALL)
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50"""


@_query("op12_fp_search", SEARCH_SQL)
def op12_fp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fp_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query("op13_toxicity")
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out("doc_id", 5, 0))
    return scored.withColumnRenamed("key", "doc_id")
