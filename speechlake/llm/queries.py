"""The queries of this subpackage, one per operator, and their SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.llm.conversation_repair import conversation_reports
from speechlake.llm.line_dedup import line_dedup
from speechlake.llm.minhash_forest import near_duplicates
from speechlake.llm.mixing import mix
from speechlake.llm.packing import pack_documents
from speechlake.llm.phrase_graph import collocations
from speechlake.llm.pii import find_pii
from speechlake.llm.quality_rules import quality_rules
from speechlake.llm.simhash import fingerprint_documents
from speechlake.llm.token_files import read_token_files, write_token_files
from speechlake.llm.tool_calls import Schemas, link_tool_calls
from speechlake.llm.vector_graph import near_vectors
from speechlake.llm.warc import read_warc, write_warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(_read(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), tri AS (
  SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri) WHERE n >= 2
), cover AS (
  SELECT doc_id, count(DISTINCT i + d) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS d) GROUP BY doc_id
), ln AS (
  SELECT doc_id, count(*) AS lines, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), rated AS (
  SELECT w.doc_id, w.source, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(ln.n, 0)::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words, coalesce(ln.lines, 0) AS lines
  FROM w LEFT JOIN ln USING (doc_id) LEFT JOIN cover USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         100 * n_symbols > 10 * word_chars AS symbols_failed, 100 * n_dup_lines > 30 * lines AS lines_failed
  FROM rated
), failures AS (
  SELECT source, rule, count(*) AS n, count_if(failed) AS f
  FROM (SELECT source, unnest([0, 1, 2]) AS rule, unnest([base_failed, symbols_failed, lines_failed]) AS failed FROM judged)
  GROUP BY source, rule
), prior AS (
  SELECT rule, m, CASE WHEN v * 1000 <= m * (1 - m) THEN 1000.0 ELSE greatest(1.0, m * (1 - m) / v - 1) END AS k
  FROM (SELECT rule, m, q - m * m AS v FROM (SELECT rule, sum(f) / sum(n) AS m, sum(f * f / n) / sum(n) AS q FROM failures GROUP BY rule))
), verdict AS (
  SELECT source, bool_or(rule = 0 AND rate > 0.5) AS whole, bool_or(rule = 1 AND rate > bound) AS symbols, bool_or(rule = 2 AND rate > bound) AS lines
  FROM (SELECT source, rule, (f + m * k) / (n + k) AS rate, m + sqrt(m * (1 - m) / (k + 1)) AS bound FROM failures JOIN prior USING (rule))
  GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR verdict.whole OR verdict.symbols AND symbols_failed OR verdict.lines AND lines_failed) AS kept
FROM judged JOIN verdict ON judged.source IS NOT DISTINCT FROM verdict.source
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, i, lines[i] AS line,
         translate(regexp_replace(regexp_replace(lines[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), common AS (
  SELECT k, max(doc_id) AS keep_id FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.*, common.k IS NOT NULL AND doc_id <> keep_id AS dropped FROM l LEFT JOIN common USING (k)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"), ngram=4, percent=80)


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents
), sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), sz AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), link AS MATERIALIZED (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2
  ) p JOIN sz sa ON sa.doc_id = p.a JOIN sz sb ON sb.doc_id = p.b WHERE 100 * p.c >= 80 * (sa.n + sb.n - p.c)
), reach AS (
  SELECT doc_id AS d, doc_id AS r FROM documents
  UNION
  SELECT reach.d, link.b FROM reach JOIN link ON reach.r = link.a
)
SELECT doc_id, coalesce(sz.n, 0)::BIGINT AS n_shingles, c.m AS component_id, doc_id = c.m AS kept
FROM documents LEFT JOIN sz USING (doc_id) JOIN (SELECT d AS doc_id, min(r) AS m FROM reach GROUP BY d) c USING (doc_id)
"""


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_read(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_read(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), per AS (
  SELECT row_number() OVER (ORDER BY source NULLS LAST) - 1 AS idx, source, source_size, 2.0 * source_size AS cap
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)
), weighed AS (
  SELECT *, [5, 2, 1][idx % 3 + 1] AS weight FROM per
), levels AS (
  SELECT *, row_number() OVER o AS k,
         (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW o AS (ORDER BY cap / weight, idx)
), open AS (
  SELECT k AS open_k, level AS open_level FROM levels WHERE level * weight < cap ORDER BY k LIMIT 1
), targets AS (
  SELECT idx, source, source_size, CASE WHEN k >= open_k THEN open_level * weight ELSE cap END AS target,
         ceil(source_size / 64)::BIGINT AS blocks
  FROM levels LEFT JOIN open ON true
), arcs AS (
  SELECT idx, blocks, CASE WHEN idx = max(idx) OVER () THEN 2147483648
    ELSE floor(2147483648 * (sum(target) OVER (ORDER BY idx) / sum(target) OVER ()))::BIGINT END AS high
  FROM targets WHERE target > 0
), bounded AS (
  SELECT *, lag(high, 1, 0) OVER (ORDER BY idx) AS low FROM arcs
), slots AS (
  SELECT i AS slot, (i * 1327217885) % 2147483648 AS point
  FROM (SELECT unnest(range((SELECT floor(sum(target) / 64 + 0.5)::BIGINT FROM targets))) AS i)
), ranked AS (
  SELECT idx, blocks, row_number() OVER (PARTITION BY idx ORDER BY slot) - 1 AS r
  FROM slots JOIN bounded ON point >= low AND point < high
), times AS (
  SELECT idx, r % blocks AS block, count(*) AS times FROM ranked WHERE r < 2 * blocks GROUP BY 1, 2
), placed AS (
  SELECT doc_id, size, idx, source_size, target,
         (coalesce(sum(size) OVER (PARTITION BY idx ORDER BY md5(doc_id::VARCHAR), doc_id
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
), pieces AS (
  SELECT doc_id, idx, block, least(start + size, (block + 1) * 64) - greatest(start, block * 64) AS part
  FROM (SELECT *, unnest(range(start // 64, (start + size - 1) // 64 + 1)) AS block FROM placed WHERE size > 0)
), taken AS (
  SELECT doc_id, sum(part * times)::BIGINT AS taken FROM pieces JOIN times USING (idx, block) GROUP BY doc_id
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM placed LEFT JOIN taken USING (doc_id)
"""


TOOLS: Schemas = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "lookup": {"query": ("string", True), "exact": ("boolean", True)},
    "count": {"limit": ("integer", True)},
}


def tool_messages(conversations: DataFrame) -> DataFrame:
    """The conversations table read as an agent's log, for link_tool_calls.

    Each assistant turn calls a tool, under the MD5 of its place and with its text as an argument;
    each later user turn is the result of the call that the turn before it would have made. A call needs the
    result of the assistant turn before it; in every seventh conversation that of the turn after it, in
    every eleventh both, so that those wait for each other.
    """
    n, mine = F.length("text"), F.col("role") == "assistant"
    place = lambda turn: F.md5(F.concat_ws(":", "conv_id", turn))
    tool = F.element_at(F.array(F.lit("search"), F.lit("lookup"), F.lit("count")), (F.pmod("turn", F.lit(3)) + 1).cast("int"))
    query = F.col("text")
    found = F.when(n % 5 == 0, F.to_json(F.struct(F.lit("many").alias("limit"), query.alias("query")))).otherwise(F.to_json(F.struct((n % 10).alias("limit"), query.alias("query"))))
    exact = F.to_json(F.struct(F.when(n % 5 > 0, n % 2 == 0).alias("exact"), query.alias("query")))
    arguments = F.when(tool == "search", found).when(tool == "lookup", exact).otherwise(F.to_json(F.struct((n % 10).alias("limit"))))
    answer = (F.col("role") == "user") & (F.col("turn") > 0)
    before, behind = place(F.col("turn") - 2), place(F.col("turn") + 2)
    depends = F.when(F.col("conv_id") % 11 == 0, F.array(before, behind)).when(F.col("conv_id") % 7 == 0, F.array(behind)).otherwise(F.array(before))
    return conversations.select(
        "conv_id", "turn", F.when(answer, "tool").otherwise(F.col("role")).alias("role"), "text",
        F.when(mine, place(F.col("turn"))).when(answer, place(F.col("turn") - 1)).alias("call_id"),
        F.when(mine, tool).alias("tool"), F.when(mine, arguments).alias("arguments"), F.when(mine, depends).alias("depends"),
    )


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link_tool_calls(tool_messages(_read(spark, sf_dir, "conversations")), TOOLS)
    return out.withColumn("json_sha256", F.sha2("json", 256)).drop("json")


OP5_SQL = r"""
WITH m AS (
  SELECT *, length(text) AS n, role = 'assistant' AS is_call, role = 'user' AND turn > 0 AS answer,
         ['search', 'lookup', 'count'][turn % 3 + 1] AS tool, to_json(text)::VARCHAR AS q
  FROM conversations
), a AS (
  SELECT *, CASE WHEN is_call THEN md5(conv_id || ':' || turn) WHEN answer THEN md5(conv_id || ':' || (turn - 1)) END AS cid,
         CASE WHEN tool = 'search' THEN '{"limit":' || CASE WHEN n % 5 = 0 THEN '"many"' ELSE (n % 10)::VARCHAR END || ',"query":' || q || '}'
              WHEN tool = 'lookup' THEN '{' || CASE WHEN n % 5 = 0 THEN '' ELSE '"exact":' || (n % 2 = 0)::VARCHAR || ',' END || '"query":' || q || '}'
              ELSE '{"limit":' || (n % 10) || '}' END AS args,
         tool = 'count' OR n % 5 > 0 AS valid
  FROM m
), calls AS (
  SELECT conv_id, cid, min(turn) AS call_turn FROM a WHERE is_call GROUP BY 1, 2
), runs AS (
  SELECT *, max(call_turn) OVER run AS last, count(*) OVER run AS calls
  FROM (SELECT *, call_turn - 2 * row_number() OVER (PARTITION BY conv_id ORDER BY call_turn) AS start FROM calls) WINDOW run AS (PARTITION BY conv_id, start)
), placed AS (
  SELECT conv_id, cid, call_turn, conv_id % 11 = 0 AND calls > 1 AS stuck, CASE WHEN conv_id % 11 <> 0 AND conv_id % 7 = 0 THEN last ELSE call_turn END AS key,
         CASE WHEN conv_id % 11 <> 0 AND conv_id % 7 = 0 THEN (last - call_turn) // 2 ELSE 0 END AS depth
  FROM runs
), l AS (
  SELECT a.*, CASE WHEN answer THEN c.call_turn END AS ct, key, depth, coalesce(stuck, false) AS stuck FROM a LEFT JOIN placed c ON a.conv_id = c.conv_id AND a.cid = c.cid
), s AS (
  SELECT conv_id, turn, CASE WHEN answer AND ct IS NOT NULL THEN 'tool' ELSE role END AS role,
         CASE WHEN is_call OR ct IS NOT NULL THEN cid END AS call_id, ct AS call_turn,
         CASE WHEN is_call AND stuck THEN 'stuck' WHEN is_call AND valid THEN 'call' WHEN is_call THEN 'bad_call' WHEN ct IS NOT NULL THEN 'result'
              WHEN answer THEN 'orphan' ELSE 'message' END AS status, text, args, tool, is_call, key, depth
  FROM l
), j AS (
  SELECT *, '{' || CASE WHEN is_call THEN '"call":{"arguments":' || args || ',"id":"' || call_id || '","name":"' || tool || '"},' ELSE '' END
         || '"content":' || to_json(text)::VARCHAR || ',' || CASE WHEN status = 'result' THEN '"in_reply_to":"' || call_id || '",' ELSE '' END
         || '"role":"' || role || '"}' AS json
  FROM s
)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(key, turn), coalesce(depth, 0), (status = 'result')::INT, turn, json) - 1 AS position,
       role, call_id, call_turn, status, sha256(json) AS json_sha256
FROM j
"""


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(_read(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_warc(_read(spark, sf_dir, "pages"))
    return read_warc(index, with_html=False).drop("url")


OP8_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_token_files(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), vocabulary=50_257, end_id=2)
    return read_token_files(manifest, with_ids=False)


def damaged(conversations: DataFrame) -> DataFrame:
    """The conversations with faults by the checksum of each row's place; `there` is false for the rows that are dropped."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn"))) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    rows = rows.withColumn("_copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("there"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = conversation_reports(damaged(_read(spark, sf_dir, "conversations")), there="there")
    return reports.withColumn("conv_id", F.col("conv_id").cast("long"))


def _repair_sql() -> str:
    """The repair as a recursion from the last row of each conversation, with costs, audits and texts of the four states."""

    def joined(line: str, rest: str) -> str:
        return f"{line} || CASE WHEN {rest} = '' THEN '' ELSE chr(10) || {rest} END"

    def option(cost: str, letter: str, to: str, line: str | None) -> str:
        text = joined(line, f"{to}.r") if line else f"{to}.r"
        return f"{{'c': {to}.c + {cost}, 'a': '{letter}' || {to}.a, 'r': {text}}}"

    following = {"e": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    never = "{'c': 1000000::BIGINT, 'a': '~', 'r': ''}"
    rows, first, second = [], [], []
    for q, f in following.items():
        keep = [f"CASE WHEN m.ini = '{f}' AND NOT m.doomed THEN {option('m.extra', 'K', f'p.{f}', 'm.line')} ELSE {never} END"]
        if q == "e":
            keep.append(f"CASE WHEN m.ini = 's' AND NOT m.doomed THEN {option('m.extra', 'K', 'p.s', 'm.line')} ELSE {never} END")
        reroled = "'" + name[f] + ":' || m.text"
        options = [option("4", "D", f"p.{q}", None), *keep, f"CASE WHEN m.doomed THEN {never} ELSE {option('3 + m.extra', 'R', f'p.{f}', reroled)} END"]
        rows.append(f"list_sort([{', '.join(options)}])[1] AS {q}")
        inserted = "'" + name[f] + ":'"
        first.append(f"list_sort([b.{q}, {option('3', 'I', f'b.{f}', inserted)}])[1] AS {q}1")
        second.append(f"list_sort([b.{q}, {option('3', 'I', f'b.{f}1', inserted)}])[1] AS {q}")
    end = {"e": (0, "", ""), "s": (6, "II", "user:\\nassistant:"), "u": (3, "I", "assistant:"), "a": (0, "", "")}
    ends = ", ".join("{'c': %d::BIGINT, 'a': '%s', 'r': %s} AS %s" % (c, a, "'" + r.replace("\\n", "' || chr(10) || '") + "'", q) for q, (c, a, r) in end.items())
    return rf"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v
    FROM (SELECT unnest(range(256))::BIGINT AS n))
), k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT)),
                         lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) % 20 AS kind
  FROM conversations, crc
), dam AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) FROM k WHERE kind <> 0)
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM dam
), m AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
         role || ':' || text AS line, substr(role, 1, 1) AS ini, body = '' OR nth > 1 AS doomed,
         CASE WHEN body = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
         CASE WHEN body <> '' AND nth = 1 AND right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS extra
  FROM seen
), rec AS (
  SELECT DISTINCT conv_id, n + 1 AS i, {ends} FROM m
  UNION ALL
  SELECT b.conv_id, b.i, {', '.join(second)} FROM (
    SELECT b.*, {', '.join(first)} FROM (
      SELECT m.conv_id, m.i, {', '.join(rows)} FROM rec p JOIN m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.i = p.i - 1) b) b
), best AS (SELECT conv_id, e FROM rec WHERE i = 1
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM m) GROUP BY conv_id
), every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT v.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(e.c, 0)::BIGINT AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(e.r, '')) AS repaired_sha256
FROM every v LEFT JOIN counts c ON v.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON v.conv_id IS NOT DISTINCT FROM b.conv_id
"""


OP11_SQL = _repair_sql()


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_read(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH w AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, row_number() OVER () AS row, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM w
), g AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k) GROUP BY ALL
), n AS (
  SELECT lang, sum(f) AS n FROM g WHERE k = 1 GROUP BY lang
), cand AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE k > 1 AND f >= 30
), cuts AS (
  SELECT c.lang, c.phrase, c.a, cut, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a) // (l.f + r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand) c
  JOIN g l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:cut], ' ') JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[cut + 1:], ' ')
), scored AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), longer AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM cand)) GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM scored LEFT JOIN longer USING (lang, phrase) JOIN n USING (lang)
WHERE longer IS NULL OR 100 * longer < 80 * a
QUALIFY rank <= 2000
"""


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_read(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), r AS (
  SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN (SELECT id AS vec_id, min(c) AS component_id FROM r GROUP BY id) USING (vec_id) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a) USING (vec_id)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_rules, op2_line_dedup, op3_pii, op4_mixing, op5_tool_calls, op6_packing, op7_simhash, op8_warc, op9_token_files, op10_near_duplicates, op11_conversation_repair, op12_collocations, op13_near_vectors)
}

SQL: dict[str, str] = {
    "op1_quality_rules": OP1_SQL,
    "op2_line_dedup": OP2_SQL,
    "op4_mixing": OP4_SQL,
    "op5_tool_calls": OP5_SQL,
    "op8_warc": OP8_SQL,
    "op10_near_duplicates": OP10_SQL,
    "op11_conversation_repair": OP11_SQL,
    "op12_collocations": OP12_SQL,
    "op13_near_vectors": OP13_SQL,
}
