"""Derived views over the driver's tables (see FIXTURES.md section C).

Each view exists twice: as a DataFrame builder for the Spark side and as
SQL text that DuckDB runs for the oracle.  The SQL text is composed into
``WITH`` clauses by ``with_views``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.sources.tables import table


def steps(spark: SparkSession, sf: str) -> DataFrame:
    from tracefold.operators.numbering import global_rank
    ev = table(spark, sf, "events")
    k = F.regexp_extract("props", r"([0-9]+)", 1).cast("double")
    # per-user numbering without a per-user window (a user may hold a third of all events)
    ev = global_rank(ev, ["ts", "event_id"], out="_rn", group=["user_id"])
    return ev.select(
        F.col("user_id").alias("episode_id"),
        (F.col("_rn") - 1).cast("bigint").alias("t"),
        "event_id",
        F.col("event_type").alias("head"),
        (F.col("value") / 100).alias("reward"),
        (k / 100).alias("value_est"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("exit_code"),
        (-(F.lit(0.1) + k / 100)).alias("old_logp"),
        (-(F.lit(0.1) + (F.col("event_id") % 97) / F.lit(97.0))).alias("new_logp"),
    )


def traces(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").alias("d")
    lab = table(spark, sf, "labels").alias("l")
    lines = F.replace(F.col("d.text"), F.lit("\n"), F.lit(" ; "))  # every line of the document is a command
    return d.join(lab, F.col("d.doc_id") == F.col("l.doc_id"), "left").select(
        F.col("d.doc_id").alias("seq"),
        F.col("d.source").alias("dataset"),
        F.concat(F.col("d.lang"), F.lit("/"), F.col("d.source")).alias("session"),
        F.concat(F.lit("cd /"), F.col("d.lang"), F.lit(" ; "), lines).alias("input"),
        F.col("d.text").alias("output"),
        F.lit("").alias("context_value"),
        F.coalesce(F.col("l.toxic"), F.lit(0)).alias("exit_code"),
        F.when(F.col("l.quality") == 1, F.lit(0.95))
         .when(F.col("l.quality") == 0, F.lit(0.5))
         .otherwise(F.lit(0.92)).alias("redundancy_score"),
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Repeat runs of a command: the turns of a conversation, all of them."""
    c = table(spark, sf, "conversations")
    return c.select(
        F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("k"),
        (F.col("turn") + 1).cast("bigint").alias("run_no"),
        F.col("text").alias("output"),
        F.when((F.col("conv_id") + F.col("turn")) % 7 == 3, 1).otherwise(0).alias("exit_code"))


def cmds(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select(
        "page_id",
        F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("session"),
        F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1).alias("path"),
    )
    m = F.col("page_id") % 4
    cmd = (F.when(m == 0, F.concat(F.lit("cd "), F.col("path")))
            .when(m == 1, F.lit("cd .."))
            .when(m == 2, F.lit("ls -la"))
            .otherwise(F.concat(F.lit("cd "), F.expr("substr(path, 2)"), F.lit("."))))
    return p.select("session", F.col("page_id").alias("ord"), cmd.alias("cmd"))


def _turn_pairs(spark: SparkSession, sf: str):
    c = table(spark, sf, "conversations")
    u, a = c.alias("u"), c.alias("a")
    return u.join(a, (F.col("u.conv_id") == F.col("a.conv_id"))
                  & (F.col("a.turn") == F.col("u.turn") + 1))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _turn_pairs(spark, sf).select(
        F.col("u.conv_id").alias("conv_id"), F.col("u.turn").alias("turn"),
        F.col("u.role").alias("role"), F.col("u.text").alias("pred"),
        F.col("a.text").alias("ref"))


def ctx(spark: SparkSession, sf: str) -> DataFrame:
    return _turn_pairs(spark, sf).select(
        F.col("u.conv_id").alias("conv_id"), F.col("u.turn").alias("turn"),
        F.concat(F.lit("/"), F.col("u.role")).alias("pwd_before"),
        F.when(F.col("u.turn") % 4 == 0, F.concat(F.lit("/"), F.col("a.role")))
         .otherwise(F.concat(F.lit("/"), F.col("u.role"))).alias("pwd_after"),
        F.col("u.text").alias("ls_before"),
        F.when(F.col("u.turn") % 4 == 3, F.col("u.text"))
         .otherwise(F.col("a.text")).alias("ls_after"),
        F.concat(F.lit("A=1\nOLDPWD="), F.col("u.role")).alias("env_before"),
        F.concat(F.lit("A=1\nOLDPWD="), F.col("a.role")).alias("env_after"),
    )


BUILDERS = {"steps": steps, "traces": traces, "runs": runs, "cmds": cmds,
            "pairs": pairs, "ctx": ctx}

# DuckDB text of the same views (oracle side).
SQL = {
    "steps": """
SELECT user_id AS episode_id,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS t,
       event_id, event_type AS head, value/100 AS reward,
       CAST(regexp_extract(props,'([0-9]+)',1) AS DOUBLE)/100 AS value_est,
       CASE WHEN event_type='error' THEN 1 ELSE 0 END AS exit_code,
       -(CAST(0.1 AS DOUBLE) + CAST(regexp_extract(props,'([0-9]+)',1) AS DOUBLE)/100) AS old_logp,
       -(CAST(0.1 AS DOUBLE) + (event_id % 97)/CAST(97 AS DOUBLE)) AS new_logp
FROM events""",
    "traces": """
SELECT d.doc_id AS seq, d.source AS dataset, concat(d.lang,'/',d.source) AS session,
       'cd /' || d.lang || ' ; ' || replace(d.text, chr(10), ' ; ') AS input,
       d.text AS output, '' AS context_value, coalesce(l.toxic,0) AS exit_code,
       CASE WHEN l.quality=1 THEN CAST(0.95 AS DOUBLE) WHEN l.quality=0 THEN CAST(0.5 AS DOUBLE)
            ELSE CAST(0.92 AS DOUBLE) END AS redundancy_score
FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id""",
    "runs": """
SELECT 'conv/' || conv_id AS k, CAST(turn + 1 AS BIGINT) AS run_no, text AS output,
       CASE WHEN (conv_id + turn) % 7 = 3 THEN 1 ELSE 0 END AS exit_code FROM conversations""",
    "cmds": """
SELECT session, page_id AS ord,
       CASE page_id % 4 WHEN 0 THEN concat('cd ',path) WHEN 1 THEN 'cd ..' WHEN 2 THEN 'ls -la'
            ELSE concat('cd ',substr(path,2),'.') END AS cmd
FROM (SELECT page_id, regexp_extract(url,'^https?://([^/]+)',1) AS session,
             regexp_extract(url,'^https?://[^/]+(/[^?#]*)',1) AS path FROM pages) p""",
    "pairs": """
SELECT u.conv_id, u.turn, u.role, u.text AS pred, a.text AS ref
FROM conversations u JOIN conversations a ON u.conv_id=a.conv_id AND a.turn=u.turn+1""",
    "ctx": """
SELECT u.conv_id, u.turn, concat('/',u.role) AS pwd_before,
       CASE WHEN u.turn % 4 = 0 THEN concat('/',a.role) ELSE concat('/',u.role) END AS pwd_after,
       u.text AS ls_before,
       CASE WHEN u.turn % 4 = 3 THEN u.text ELSE a.text END AS ls_after,
       concat('A=1',chr(10),'OLDPWD=',u.role) AS env_before,
       concat('A=1',chr(10),'OLDPWD=',a.role) AS env_after
FROM conversations u JOIN conversations a ON u.conv_id=a.conv_id AND a.turn=u.turn+1""",
}


def with_views(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix an oracle query with the CTEs it needs (fixtures first).

    ``extra`` CTEs follow in order; any named ``*_rec`` makes it RECURSIVE.
    """
    parts = [f"{n} AS ({SQL[n].strip()})" for n in names]
    for n, text in (extra or {}).items():
        parts.append(f"{n} AS ({text.strip()})")
    if not parts:
        return body.strip()
    rec = "RECURSIVE " if any(n.endswith("_rec") for n in (extra or {})) else ""
    return "WITH " + rec + ",\n".join(parts) + "\n" + body.strip()
