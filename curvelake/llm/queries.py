"""The registered queries of the operators, each returning the whole result over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelake.llm import (
    decontaminate,
    language_id,
    line_rules,
    near_dedup,
    packing,
    periodic_runs,
    prefix_trie,
    quality_net,
    quotes,
    secrets,
    sharding,
    token_files,
    toxicity,
)
from curvelake.llm.common import scratch, table
from curvelake.plans.registry import Build, Query

REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def add(build: Build) -> Build:
        REGISTRY[name] = Query(name, build, sql)
        return build

    return add


LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"'[^\x20\x09-\x0D]+'"
NEAR_DEDUP_SQL = f"""
WITH RECURSIVE cut AS (SELECT doc_id, regexp_extract_all({LOWERED}, {WORDS}) AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM cut, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY 1),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
near AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS doc_id, b AS other FROM near UNION SELECT reach.doc_id, near.b FROM reach JOIN near ON near.a = reach.other),
least_one AS (SELECT doc_id, least(doc_id, min(other)) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id,
       d.doc_id = coalesce(component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN size USING (doc_id) LEFT JOIN least_one USING (doc_id)
"""


@query("op1_near_dedup", NEAR_DEDUP_SQL)
def near_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85).drop("text_key")


@query("op3_packing")
def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


@query("op9_token_files")
def token_files_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder)
    return token_files.digests(token_files.read_tokens(spark, folder))


DECONTAMINATION_SQL = f"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS words
  FROM items, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS words
  FROM cut, sizes, unnest(range(1, len(w) - n + 2)) AS u(i) WHERE len(w) >= n),
found AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (n, words)),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM found, unnest(range(0, n)) AS u(k) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM found GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM cut LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op8_decontamination", DECONTAMINATION_SQL)
def decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


_LINE_FAILS = rf"""
CASE WHEN regexp_matches(line, '[#*$%&|<>»·›]|!!') AND (
       len(regexp_extract_all(line, '\x20[|»·›]\x20')) >= 3
       OR 100 * len(regexp_extract_all(line, '{line_rules.SYMBOLS}+')) > {line_rules.SYMBOL_PERCENT} * n
       OR 100 * len(regexp_extract_all(line, '!!+([\x20\x09-\x0D]|$)')) > {line_rules.SHOUT_PERCENT} * n) THEN true
     WHEN NOT regexp_matches(line, '[.!?:;,…。！？]') AND n >= {line_rules.UNMARKED_WORDS} THEN true
     WHEN regexp_matches(lower(line), '{line_rules.NAVIGATION}') THEN true
     WHEN regexp_matches(lower(line), '{line_rules.BOILERPLATE}') THEN
       100 * list_sum(list_transform(list_filter(regexp_split_to_array(lower(line), '{line_rules.SENTENCE_END}'), lambda x: regexp_matches(x, '{line_rules.BOILERPLATE}')), lambda x: length(x)))
       >= {line_rules.NOTICE_PERCENT} * length(line)
     ELSE false END"""
LINE_RULES_SQL = f"""
WITH cut AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
triple AS (SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS x FROM cut, unnest(range(1, len(w) - 1)) AS u(i)),
twice AS (SELECT doc_id, i FROM triple QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, unnest(range(0, 3)) AS u(k) GROUP BY 1),
line AS (SELECT doc_id, line FROM cut, unnest(string_split(t, chr(10))) AS u(line) WHERE regexp_matches(line, '{line_rules.NOT_SPACE}')),
each AS (SELECT doc_id, line, count(*) AS copies, regexp_extract_all(line, {WORDS}) AS lw FROM line GROUP BY ALL),
judged AS (SELECT *, len(lw) AS n FROM each),
kept_line AS (
  SELECT doc_id, sum(copies - 1) AS n_dup_lines, sum(CASE WHEN {_LINE_FAILS} THEN 0 ELSE length(array_to_string(lw, '')) END) AS kept_chars
  FROM judged GROUP BY 1),
counts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '{line_rules.SYMBOLS}'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(kept_chars, 0)::BIGINT AS kept_chars
  FROM cut LEFT JOIN repeated USING (doc_id) LEFT JOIN kept_line USING (doc_id)),
verdict AS (SELECT *, n_words < {line_rules.MIN_WORDS} OR 100 * n_repeat_words > {line_rules.REPEAT_PERCENT} * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * kept_chars >= {line_rules.KEEP_PERCENT} * word_chars AS kept, kept_chars FROM verdict
"""


@query("op6_line_rules", LINE_RULES_SQL)
def line_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_rules.clean_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_chars")


@query("op7_sharding")
def sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op10_quotation_links")
def quotation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quotes.link_quotations(table(spark, sf_dir, "conversations"))
    return found.withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), "."))


@query("op5_secrets")
def secrets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))

    def joined(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in secrets.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


@query("op2_toxicity")
def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_quality_net")
def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_net.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_language_id")
def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def _crc32_sql(value: str) -> str:
    """Unsigned crc32 of a number's decimal digits in DuckDB."""
    step = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, _: xor(x >> 1, (x & 1) * 3988292384))"
    digits = f"list_transform(string_split(CAST({value} AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {digits}), lambda c, b: {step}), 4294967295)"


PERIODIC_RUNS_SQL = f"""
WITH cut AS (SELECT doc_id, coalesce(regexp_extract_all(text, {WORDS}), CAST([] AS VARCHAR[])) AS o, {_crc32_sql("doc_id")} AS h FROM documents),
place AS (SELECT *, len(o) AS n, CASE WHEN len(o) > 0 THEN (h // 10) % len(o) END AS a FROM cut),
form AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM place),
made AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(0, n), lambda i: CASE WHEN i >= a THEN o[a + (i - a) % p + 1] ELSE o[i + 1] END) ELSE o END AS w FROM form),
five AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 5], ' ') AS s FROM made, unnest(range(0, n - 4)) AS u(i) WHERE n >= 5),
pair AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM five x JOIN five y ON x.doc_id = y.doc_id AND x.s = y.s AND y.i > x.i),
chain AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pair),
stretch AS (SELECT doc_id, q, min(i) AS start, count(*) + 4 + q AS length FROM chain GROUP BY doc_id, q, island),
run AS (SELECT doc_id, start, length, min(q) AS period FROM stretch WHERE length >= greatest(6, 4 * q) GROUP BY 1, 2, 3),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS each
  FROM run GROUP BY 1),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) = 1),
dropped AS (SELECT DISTINCT doc_id, i FROM run, unnest(range(start + period, start + length)) AS u(i)),
word AS (SELECT doc_id, i, w[i + 1] AS word FROM made, unnest(range(0, n)) AS u(i)),
rest AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM word ANTI JOIN dropped USING (doc_id, i) GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
       (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(each, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM made LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN rest USING (doc_id)
"""


def repeated_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the documents has its words from some place on replaced by copies of the first few of them.

    With h = crc32(doc_id), g = h div 10 and n words, a = g % n and p = 1 + (n - a) div (3 + g % 8): if h % 10 = 0, word i >= a
    becomes word a + (i - a) % p. A null doc_id changes nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.array_remove(F.split(F.col("text").cast("string"), line_rules.SPACE), "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), h.alias("h"))
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("g", F.floor(F.col("h") / 10))
    rows = rows.withColumn("a", F.when(F.size("w") > 0, F.pmod("g", F.size("w"))))
    rows = rows.withColumn("p", F.expr("1 + (size(w) - a) div (3 + g % 8)"))
    made = F.expr("array_join(transform(w, (x, i) -> CASE WHEN i >= a THEN get(w, CAST(a + (i - a) % p AS INT)) ELSE x END), ' ')")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), made).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs", PERIODIC_RUNS_SQL)
def runs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(repeated_tails(table(spark, sf_dir, "documents")))
    # Exact comparison of length / period; the runs come by start and period, so the first of equals stays.
    greater = "aggregate(runs, CAST(NULL AS struct<start: bigint, length: bigint, period: bigint>), (b, r) -> CASE WHEN b IS NULL OR r.length * b.period > b.length * r.period THEN r ELSE b END)"
    each = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')"
    return found.withColumn("best", F.expr(greater)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.expr(each), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


PREFIX_TRIE_SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
conv AS (SELECT DISTINCT conv_id, {_crc32_sql("conv_id")} % 6 AS h FROM turns),
whole AS (
  SELECT conv_id, conv_id AS c, k, role, text FROM turns JOIN conv USING (conv_id) WHERE k > h
  UNION ALL SELECT v.conv_id, t.conv_id - 100000000000, k, role, text FROM conv v JOIN turns t ON t.conv_id = v.conv_id - v.conv_id % 100 WHERE k <= h),
placed AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY c, k) AS d, role, text FROM whole),
path AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY d) AS s FROM placed GROUP BY 1),
every AS (SELECT conv_id, s FROM conv LEFT JOIN path USING (conv_id)),
prefix AS (SELECT conv_id, d, CASE WHEN d > 0 THEN s[1:d] END AS key, d = coalesce(len(s), 0) AS ends FROM every, unnest(range(0, coalesce(len(s), 0) + 1)) AS u(d)),
node AS (
  SELECT key, d, count(*) AS n_convs, min(conv_id) AS conv_id, (count(*) - 1) * coalesce(length(key[d].text), 0) AS gain,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM prefix GROUP BY 1, 2),
above AS (SELECT n.conv_id, n.d, p.conv_id AS parent_conv_id, p.d AS up FROM node n JOIN node p ON p.d = n.d - 1 AND p.key IS NOT DISTINCT FROM (CASE WHEN n.d > 1 THEN n.key[1 : n.d - 1] END)),
child AS (SELECT parent_conv_id AS conv_id, up AS d, count(*) AS n_children FROM above GROUP BY 1, 2),
full_node AS (SELECT node.*, parent_conv_id, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN above USING (conv_id, d) LEFT JOIN child USING (conv_id, d)),
under AS (
  SELECT CASE WHEN u.d > 0 THEN key[1 : u.d] END AS key, u.d, sum(gain) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM full_node f, unnest(range(0, f.d + 1)) AS u(d) GROUP BY 1, 2)
SELECT f.conv_id, f.d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM full_node f JOIN under u ON f.d = u.d AND f.key IS NOT DISTINCT FROM u.key
"""


@query("op13_prefix_trie", PREFIX_TRIE_SQL)
def trie_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), rebuild=True)


QUOTED_REPLIES_SQL = r"""
WITH m AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
line AS (
  SELECT conv_id, turn, u.i AS pos, trim(regexp_replace(lower(string_split(text, chr(10))[u.i]), '[\x20\x09-\x0D]+', ' ', 'g')) AS said
  FROM m, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)),
known AS (SELECT *, pos - row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS island FROM line WHERE said <> ''),
says AS (
  SELECT conv_id, turn, said FROM known
  UNION SELECT conv_id, turn, string_agg(said, ' ' ORDER BY pos) FROM known GROUP BY conv_id, turn, island),
ask AS (
  SELECT m.conv_id, m.turn, l.said FROM m JOIN line l ON l.conv_id = m.conv_id AND l.pos = 1 AND l.said <> '' AND l.turn = (m.conv_id + m.turn) % (m.turn - 1)
  WHERE m.turn >= 2),
found AS (SELECT ask.conv_id, ask.turn, max(says.turn) AS source FROM ask JOIN says ON says.conv_id = ask.conv_id AND says.said = ask.said AND says.turn < ask.turn GROUP BY 1, 2)
SELECT m.conv_id, m.turn, CASE WHEN ask.turn IS NULL THEN 0 ELSE 1 END::BIGINT AS n_quotes, CASE WHEN source IS NULL THEN 0 ELSE 1 END::BIGINT AS n_linked,
       coalesce(source, lag(m.turn) OVER (PARTITION BY m.conv_id ORDER BY m.turn))::BIGINT AS reply_to
FROM m LEFT JOIN ask ON ask.conv_id = m.conv_id AND ask.turn = m.turn LEFT JOIN found ON found.conv_id = m.conv_id AND found.turn = m.turn
"""


@query("op10_quoted_replies", QUOTED_REPLIES_SQL)
def quoted_replies_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message from turn 2 on, made to quote the first line of an earlier one, linked back: the table itself holds no quotes."""
    messages = table(spark, sf_dir, "conversations").filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    first = F.split(F.coalesce("text", F.lit("")), "\n", -1)[0]
    lines = messages.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), first.alias("_first")).filter(quotes.normalised(F.col("_first")) != "")
    wanted = F.when(F.col("turn") >= 2, (F.col("conv_id") + F.col("turn")) % F.nullif(F.col("turn") - 1, F.lit(0)))
    both = messages.withColumn("_wanted", wanted).join(lines, (F.col("conv_id") == F.col("_conv")) & (F.col("_wanted") == F.col("_turn")), "left")
    text = F.when(F.col("_first").isNotNull(), F.concat(F.lit("> "), "_first", F.lit("\n"), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    found = quotes.link_quotations(both.select("conv_id", "turn", "role", text.alias("text")))
    return found.select("conv_id", "turn", "n_quotes", "n_linked", "reply_to")
