"""Query-log triage, text classification, masking."""

from __future__ import annotations

from pyspark.sql import functions as F

from estate.functions import masking
from estate.operators import querylog as Q
from estate_queries import fixtures as X
from estate_queries.fixtures import CLOCK, CLOCK_SQL, with_fx


def _drifted(spark, d):
    """The log as an older engine version names it."""
    return X.query_log(spark, d).withColumnsRenamed(
        {"query_id": "query", "user_name": "usename", "status": "state",
         "start_time": "starttime", "query_text": "querytxt"})


def _triage(spark, d):
    return Q.triage(X.query_log(spark, d), CLOCK)


def _triage_half_hour(spark, d):
    return Q.triage(X.query_log(spark, d), CLOCK, min_s=1, hours=0.5)


def _drift(spark, d):
    return Q.triage(Q.normalise_log(_drifted(spark, d)), CLOCK, min_s=30, hours=48, n=50)


def _live(spark, d):
    return Q.live_queries(X.query_log(spark, d), CLOCK, min_s=86400, n=25)


def _activity(spark, d):
    sessions = X.table(spark, d, "events").select(
        X.name("wh", F.col("user_id") % 3).alias("target"),
        X.s("event_id").alias("session_id"), X.name("u", "user_id").alias("user_name"),
        F.when(F.col("event_type") == "view", "active").when(F.col("event_type") == "click", "idle")
        .when(F.col("event_type") == "error", "idle in transaction").alias("state"),
        F.when(F.col("value") > 5, F.col("ts")).alias("start_time"),
        X.name("select\n\t", "event_id").alias("query_text"))
    return Q.activity_snapshot(sessions, CLOCK, min_s=3600, n=30, own_session="17")


def _stats(spark, d):
    # Under one target all statements agree in more characters than are shown.
    same = F.when(F.col("target") == "wh1", F.repeat(F.lit("same "), F.lit(50))).otherwise("")
    log = X.query_log(spark, d).withColumns({
        "elapsed_ms": F.col("duration_s") * 1000, "query_text": F.concat(same, "query_text")})
    out = Q.statement_stats(log, min_s=20, n=15)
    return out.select("target", F.col("rank"), "statement", "calls", *[
        F.round(c, 4).alias(c) for c in ("total_s", "mean_s", "max_s")])


def _engine_stats(spark, d):
    """Two engines, one with the older column names, over the lines of each order."""
    lines = X.table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("calls"), F.sum("l_quantity").alias("total"), F.max("l_quantity").alias("longest"))
    own = [(F.col("l_orderkey") % 2 == i, t, *names) for i, t, *names in (
        (0, "new", "total_exec_time", "mean_exec_time", "max_exec_time"), (1, "old", "total_time", "mean_time", "max_time"))]
    parts = [
        Q.engine_statistics(lines.where(mine).select(
            F.lit(target).alias("target"), X.name("select\n", "l_orderkey").alias("query"), "calls",
            (F.col("total") * 1000).alias(total), (F.col("total") * 1000 / F.col("calls")).alias(mean),
            (F.col("longest") * 1000).alias(longest)), min_s=10, n=40)
        for mine, target, total, mean, longest in own]
    out = parts[0].unionByName(parts[1])
    return out.select("target", "rank", "statement", "calls", *[F.round(c, 4).alias(c) for c in ("total_s", "mean_s", "max_s")])


def _statements(spark, d):
    """Statement texts built from conversation turns, some commented, some CTEs."""
    turn, conv = F.col("turn"), F.col("conv_id")
    head = (
        F.when(conv % 6 == 0, "/* note\n */ SELECT ").when(conv % 6 == 1, "-- drop\n  WITH q AS (")
        .when(conv % 6 == 2, "FROM t; DELETE ").when(conv % 6 == 3, "insert into ")
        .when(conv % 6 == 4, "show; ").otherwise("  -- only a comment "))
    return X.table(spark, d, "conversations").select(
        "conv_id", "turn", F.concat(head, F.col("role"), F.when(turn % 2 == 0, F.lit(" Update "))
        .otherwise(F.lit("\n")), F.col("text")).alias("query_text"))


def _classify(spark, d):
    return Q.classify_log(_statements(spark, d)).select(
        "conv_id", "turn", "statement_kind", "statement_preview")


def _long(spark, d):
    log = X.query_log(spark, d).withColumn("target", F.col("user_name"))
    targets = X.table(spark, d, "customer").select(
        X.name("u", "c_custkey").alias("target"),
        (F.col("c_nationkey") % 3 != 0).alias("has_sessions"))
    return Q.long_running_counts(log, targets, CLOCK)


def _mask(spark, d):
    docs = X.table(spark, d, "documents").select("doc_id", "text")
    masked = docs.select("doc_id", masking.mask_secrets("text").alias("masked"))
    return masked.select("doc_id", F.md5(F.col("masked").cast("binary")).alias("digest"),
                         F.length("masked").cast("bigint").alias("length"),
                         F.contains("masked", F.lit("***")).alias("has_mask"))


def _mask_forms(spark, d):
    """Every credential spelling around values taken from the documents' source column."""
    value = F.concat(F.replace(F.col("source"), F.lit(" "), F.lit("")), X.s("doc_id"))
    form = F.col("doc_id") % 8
    text = (
        F.when(form == 0, F.concat(F.lit("postgresql://bob:"), value, F.lit("@host/db")))
        .when(form == 1, F.concat(F.lit("Authorization: Bearer "), value, F.lit(" | next")))
        .when(form == 2, F.concat(F.lit("curl -H bearer  "), value, F.lit(", done")))
        .when(form == 3, F.concat(F.lit("x-api-key=\""), value, F.lit("\"&page=2")))
        .when(form == 4, F.concat(F.lit("ALTER USER u\nPASSWORD '"), value, F.lit("' VALID")))
        .when(form == 5, F.concat(F.lit("token = \""), value, F.lit("\" tail")))
        .when(form == 6, F.concat(F.lit("x-token: Bearer "), value))
        .otherwise(F.concat(F.lit("Password set: yes "), value)))
    return masking.mask_columns(X.table(spark, d, "documents").select("doc_id", text.alias("text")), "text")


QUERIES = {
    "a4_column_drift": _drift,
    "q1_triage": _triage,
    "q1_triage_half_hour": _triage_half_hour,
    "q2_live_queries": _live,
    "q3_activity_snapshot": _activity,
    "q4_statement_stats": _stats,
    "q4_engine_statistics": _engine_stats,
    "q6_classify_statements": _classify,
    "q8_long_running_counts": _long,
    "k4_mask_documents": _mask,
    "k4_mask_forms": _mask_forms,
}

_TIMED = f"""
, timed AS (
  SELECT *, lower(status) IN ('running', 'queued') AS is_live,
         lower(status) IN ('failed', 'aborted', 'canceled', 'cancelled') AS is_failed,
         coalesce(duration_s, date_sub('second', start_time, {CLOCK_SQL})) AS elapsed_s
  FROM fx_query_log)
"""


def _log_sql(where: str, order: str, n: int) -> str:
    return with_fx("fx_query_log", "") + _TIMED + f"""
SELECT target, CAST(rn AS INTEGER) AS rank, query_id, user_name, status, start_time, elapsed_s,
       substr(regexp_replace(query_text, '\\s+', ' ', 'g'), 1, 180) AS query_text
FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY {order}) AS rn FROM timed WHERE {where}) t
WHERE rn <= {n}"""


def _triage_where(min_s: int, hours: float) -> str:
    recent = f"start_time >= {CLOCK_SQL} - INTERVAL {round(hours * 60)} MINUTE"
    return f"(elapsed_s >= {min_s} AND (is_live OR {recent})) OR (is_failed AND {recent})"


_URGENT = "is_live DESC, elapsed_s DESC, query_id"
# The forms of a credential that masking must find, as the library has them.
_V = "(?:'(?:[^']|'')*'|\"[^\"]*\"|[^\\s&;,]*)".replace("'", "''")
_QUOTED = "(?:'(?:[^']|'')*'|\"[^\"]*\")".replace("'", "''")
_NAMES = r"(?:secret|token|api[_\-]?key|access[_\-]?key|credential|passwd|pwd)"


def mask_sql(col: str) -> str:
    out = f"trim(regexp_replace({col}, '\\s+', ' ', 'g'), ' ')"
    out = f"regexp_replace({out}, '(://[^:/?#@\\s]+):[^@/?#\\s]*@', '\\1:***@', 'g')"
    out = (f"regexp_replace({out}, '(\\bauthorizations?\\b\"?\\s*[=:]\\s*)"
           "(?:''[^'']*''|\"[^\"]*\"|[^,;|]+)', '\\1***', 'gi')")
    out = (f"regexp_replace({out}, '\\b(bearer|basic|token)\\s+"
           "[^\\s,;|''\"=:][^\\s,;|''\"]*', '\\1 ***', 'gi')")
    out = (f"regexp_replace({out}, '(\\b[a-z0-9_.\\-]*{_NAMES}[a-z0-9_.\\-]*\\b\"?\\s*[=:]\\s*){_V}',"
           " '\\1***', 'gi')")
    return (f"regexp_replace({out}, '(\\b[a-z_]*password\\b\"?\\s*)(?:([=:]\\s*){_V}|{_QUOTED})',"
            " '\\1\\2***', 'gi')")


ORACLE = {
    "a4_column_drift": _log_sql(_triage_where(30, 48), _URGENT, 50),
    "q1_triage": _log_sql(_triage_where(60, 6), _URGENT, 20),
    "q1_triage_half_hour": _log_sql(_triage_where(1, 0.5), _URGENT, 20),
    "q2_live_queries": _log_sql("is_live AND elapsed_s >= 86400", "elapsed_s DESC, query_id", 25),
    "q3_activity_snapshot": f"""
WITH s AS (
  SELECT concat('wh', CAST(user_id % 3 AS VARCHAR)) AS target, CAST(event_id AS VARCHAR) AS session_id,
         concat('u', CAST(user_id AS VARCHAR)) AS user_name,
         CASE event_type WHEN 'view' THEN 'active' WHEN 'click' THEN 'idle'
                         WHEN 'error' THEN 'idle in transaction' END AS state,
         date_sub('second', ts, {CLOCK_SQL}) AS elapsed_s, value,
         concat('select ', CAST(event_id AS VARCHAR)) AS query_text FROM events)
SELECT target, CAST(rn AS INTEGER) AS rank, session_id, user_name, state, elapsed_s, query_text
FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY elapsed_s DESC, session_id) AS rn FROM s
      WHERE state IS NOT NULL AND state <> 'idle' AND value > 5 AND session_id <> '17' AND elapsed_s >= 3600) t
WHERE rn <= 30""",
    "q4_engine_statistics": """
SELECT target, CAST(rn AS INTEGER) AS rank, statement, calls, round(total, 4) AS total_s, round(total / calls, 4) AS mean_s, round(longest, 4) AS max_s
FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY longest DESC, calls DESC, statement) AS rn
      FROM (SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'new' ELSE 'old' END AS target, concat('select ', CAST(l_orderkey AS VARCHAR)) AS statement,
                   count(*) AS calls, CAST(sum(l_quantity) AS DOUBLE) AS total, CAST(max(l_quantity) AS DOUBLE) AS longest
            FROM lineitem GROUP BY l_orderkey) g WHERE longest >= 10) r WHERE rn <= 40""",
    "q4_statement_stats": with_fx("fx_query_log", """
SELECT target, CAST(rn AS INTEGER) AS rank, substr(statement, 1, 180) AS statement, calls, round(total_s, 4) AS total_s,
       round(mean_s, 4) AS mean_s, round(max_s, 4) AS max_s
FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY max_s DESC, statement) AS rn
      FROM (SELECT target, concat(CASE WHEN target = 'wh1' THEN repeat('same ', 50) ELSE '' END,
                                  regexp_replace(query_text, '\\s+', ' ', 'g')) AS statement,
                   count(*) AS calls, sum(duration_s * 1000 / 1000.0::DOUBLE) AS total_s,
                   avg(duration_s * 1000 / 1000.0::DOUBLE) AS mean_s,
                   max(duration_s * 1000 / 1000.0::DOUBLE) AS max_s
            FROM fx_query_log GROUP BY 1, 2) g WHERE max_s >= 20) r WHERE rn <= 15"""),
    "q6_classify_statements": r"""
WITH st AS (
  SELECT conv_id, turn, concat(
    CASE conv_id % 6 WHEN 0 THEN concat('/* note', chr(10), ' */ SELECT ')
      WHEN 1 THEN concat('-- drop', chr(10), '  WITH q AS (') WHEN 2 THEN 'FROM t; DELETE '
      WHEN 3 THEN 'insert into ' WHEN 4 THEN 'show; ' ELSE '  -- only a comment ' END,
    role, CASE WHEN turn % 2 = 0 THEN ' Update ' ELSE chr(10) END, text) AS q FROM conversations),
c AS (SELECT *, regexp_replace(regexp_replace(q, '--[^\n]*|/\*(?:.|\n)*?\*/', ' ', 'g'), '^\s+|\s+$', '', 'g') AS bare,
             regexp_replace(regexp_replace(q, '\s+', ' ', 'g'), '^ | $', '', 'g') AS line FROM st),
h AS (SELECT *, lower(rtrim(regexp_extract(bare, '^\S+'), ';')) AS head FROM c)
SELECT conv_id, turn,
       CASE WHEN bare = '' THEN 'read'
            WHEN head IN ('select', 'show', 'explain', 'table', 'values', 'describe', 'summarize', 'pivot', 'unpivot') THEN 'read'
            WHEN head IN ('with', 'from') AND NOT regexp_matches(bare, '(?i)\b(insert|update|delete|merge)\b') THEN 'read'
            ELSE 'write' END AS statement_kind,
       CASE WHEN length(line) > 120 THEN concat(substr(line, 1, 119), '…') ELSE line END AS statement_preview
FROM h""",
    "q8_long_running_counts": f"""
SELECT concat('u', CAST(c_custkey AS VARCHAR)) AS target,
       CASE WHEN c_nationkey % 3 <> 0 THEN coalesce(n, 0) END AS long_running
FROM customer LEFT JOIN (
  SELECT user_id, count(*) AS n FROM events
  WHERE event_type IN ('view', 'signup') AND date_sub('second', ts, {CLOCK_SQL}) >= 60
  GROUP BY user_id) l ON l.user_id = c_custkey""",
    "k4_mask_documents": f"""
SELECT doc_id, md5(masked) AS digest, length(masked) AS length, contains(masked, '***') AS has_mask
FROM (SELECT doc_id, {mask_sql('text')} AS masked FROM documents) m""",
    "k4_mask_forms": f"""
SELECT doc_id, {mask_sql('text')} AS text FROM (
  SELECT doc_id, CASE doc_id % 8
    WHEN 0 THEN concat('postgresql://bob:', v, '@host/db')
    WHEN 1 THEN concat('Authorization: Bearer ', v, ' | next')
    WHEN 2 THEN concat('curl -H bearer  ', v, ', done')
    WHEN 3 THEN concat('x-api-key="', v, '"&page=2')
    WHEN 4 THEN concat('ALTER USER u', chr(10), 'PASSWORD ''', v, ''' VALID')
    WHEN 5 THEN concat('token = "', v, '" tail')
    WHEN 6 THEN concat('x-token: Bearer ', v)
    ELSE concat('Password set: yes ', v) END AS text
  FROM (SELECT doc_id, concat(replace(source, ' ', ''), CAST(doc_id AS VARCHAR)) AS v FROM documents) d) f""",
}
