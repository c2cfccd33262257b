"""Queries: dedupe, splits, pooled test set, caps, uniform picks, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold.operators import curation as C
from tracefold.operators import evaluation as EV
from tracefold.plans import fixtures as V
from tracefold.plans import sqlfrag as Q
from tracefold.plans.fmt import r6
from tracefold.plans.registry import register


@register("dedupe_traces", V.with_views("""
SELECT k.seq, k.input, CAST(i.session_id AS BIGINT) AS session_id FROM kept k JOIN ids i ON k.session = i.session""",
                                        "traces", extra={
    "kept": "SELECT * FROM traces QUALIFY row_number() OVER (PARTITION BY input ORDER BY seq) = 1",
    "sess": "SELECT session, min(seq) AS first_seq FROM traces GROUP BY session",
    "ids": """SELECT session, row_number() OVER (ORDER BY first_seq, session) AS session_id FROM sess
              WHERE session IN (SELECT session FROM kept)"""}))
def q_dedupe(spark, sf):
    d = C.dedupe_traces(V.traces(spark, sf), key="input", order="seq", session="session")
    return d.select("seq", "input", F.col("session_id").cast("bigint").alias("session_id"))


_SPLIT_SQL = {
    "r1": """SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY md5(concat_ws('|', '1', 'a', CAST(seq AS VARCHAR))), seq) AS r1,
                    count(*) OVER (PARTITION BY dataset) AS n FROM traces""",
    "ev": "SELECT *, ceil(n * 0.2) AS ne FROM r1",
    "e2": """SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY md5(concat_ws('|', '1', 'b', CAST(seq AS VARCHAR))), seq) AS r2
             FROM ev WHERE r1 <= ne""",
    "sp": """SELECT seq, dataset, input, redundancy_score, CASE WHEN r2 <= ceil(ne / 2.0) THEN 'test' ELSE 'val' END AS part,
                    r2 AS part_rank FROM e2
             UNION ALL SELECT seq, dataset, input, redundancy_score, 'train', NULL FROM ev WHERE r1 > ne""",
}


def _split(spark, sf):
    return C.split_80_10_10(V.traces(spark, sf), key="seq", by="dataset", seed=1)


@register("split_80_10_10", V.with_views("SELECT seq, dataset, part FROM sp", "traces", extra=_SPLIT_SQL))
def q_split(spark, sf):
    return _split(spark, sf).select("seq", "dataset", "part")


@register("pooled_test_set", V.with_views("""
SELECT input, seq, dataset FROM sp WHERE part = 'test' AND redundancy_score > 0.9
QUALIFY row_number() OVER (PARTITION BY input ORDER BY dataset, part_rank) = 1""", "traces", extra=_SPLIT_SQL))
def q_pooled(spark, sf):
    return C.pooled_test_set(_split(spark, sf)).select("input", "seq", "dataset")


@register("cap_dataset", V.with_views("""
SELECT seq, input FROM k QUALIFY row_number() OVER (ORDER BY seq) <= 500""", "traces", extra={
    "t": "SELECT * FROM traces QUALIFY row_number() OVER (ORDER BY seq) <= 2500",
    "k": "SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY input ORDER BY seq) = 1"}))
def q_cap(spark, sf):
    t = V.traces(spark, sf).select("seq", "input")
    return C.cap_dataset(t, key="input", order="seq", size=500, max_trials=2500).select("seq", "input")


@register("pick_uniform", V.with_views("""
SELECT session, arg_min(seq, md5(concat_ws('|', '3', session, CAST(seq AS VARCHAR)))) AS seq
FROM traces GROUP BY session""", "traces"))
def q_pick_uniform(spark, sf):
    return C.pick_uniform(V.traces(spark, sf), key="session", value="seq", seed=3)


# ------------------------------------------------------------------ metrics

_WORDS = lambda e: f"list_filter(regexp_split_to_array({Q.strip(e)}, '{Q.WS}+'), lambda x: x <> '')"


def _grams_sql(tok_col: str, n: int) -> str:
    return f"list_transform(range(1, len({tok_col}) - {n} + 2), lambda i: array_to_string({tok_col}[i:i + {n} - 1], ' '))"


def _cgrams_sql(s: str, n: int) -> str:
    return f"list_transform(range(1, length({s}) - {n} + 2), lambda i: substr({s}, i, {n}))"


def _match_sql(orders) -> str:
    """Rows (conv_id, turn, kind, n, m) of clipped matches."""
    parts = []
    for kind, n, h, r in orders:
        parts.append(f"SELECT conv_id, turn, '{kind}' AS kind, {n} AS n, unnest({h}) AS g, 1 AS h, 0 AS r FROM tok")
        parts.append(f"SELECT conv_id, turn, '{kind}' AS kind, {n} AS n, unnest({r}) AS g, 0 AS h, 1 AS r FROM tok")
    u = "\nUNION ALL ".join(parts)
    return (f"SELECT conv_id, turn, kind, n, sum(least(h, r)) AS m FROM (SELECT conv_id, turn, kind, n, g, "
            f"sum(h) AS h, sum(r) AS r FROM ({u}) GROUP BY conv_id, turn, kind, n, g) GROUP BY conv_id, turn, kind, n")


def _bleu_sql() -> str:
    orders = [("w", n, _grams_sql("ht", n), _grams_sql("rt", n)) for n in range(1, 5)]
    ms = ", ".join(f"coalesce(sum(CASE WHEN n = {n} THEN m END), 0) AS m{n}" for n in range(1, 5))
    pieces, logs = [], []
    c = "1"
    for n in range(1, 5):
        sm = f"(m{n} = 0 AND hl > 1)"
        den = f"greatest(hl - {n} + 1, 1)"
        p = f"(CASE WHEN {sm} THEN (1.0 / (pow(2.0, {c}) * 5.0 / ln(hl))) / {den} ELSE m{n} / {den} END)"
        logs.append(f"CASE WHEN {p} > 0 THEN 0.25 * ln({p}) ELSE 0.0 END")
        c = f"({c} + CASE WHEN {sm} THEN 1 ELSE 0 END)"
        pieces.append(p)
    bp = "CASE WHEN hl > rl THEN 1.0 ELSE exp(1.0 - rl / hl) END"
    bleu = (f"CASE WHEN hl = 0 OR rl = 0 THEN 0.0 WHEN m1 = 0 THEN 0.0 ELSE ({bp}) * exp({' + '.join(logs)}) END")
    return f"""
WITH pairs AS ({V.SQL['pairs']}),
tok AS (SELECT conv_id, turn, role, {_WORDS('pred')} AS ht, {_WORDS('ref')} AS rt FROM pairs),
m AS ({_match_sql(orders)}),
piv AS (SELECT conv_id, turn, {ms} FROM m GROUP BY conv_id, turn),
s AS (SELECT t.role, CAST(len(t.ht) AS DOUBLE) AS hl, CAST(len(t.rt) AS DOUBLE) AS rl,
             coalesce(p.m1, 0) AS m1, coalesce(p.m2, 0) AS m2, coalesce(p.m3, 0) AS m3, coalesce(p.m4, 0) AS m4
      FROM tok t LEFT JOIN piv p ON t.conv_id = p.conv_id AND t.turn = p.turn)
SELECT role, round(sum({bleu}) / greatest(count(*), 1), 6) AS bleu, CAST(count(*) AS BIGINT) AS n_pairs
FROM s GROUP BY role"""


@register("sentence_bleu", _bleu_sql())
def q_bleu(spark, sf):
    b = EV.sentence_bleu(V.pairs(spark, sf), "pred", "ref", ["conv_id", "turn"], ["role"])
    return b.select("role", r6("bleu").alias("bleu"), F.col("n_pairs").cast("bigint").alias("n_pairs"))


_PUNCT_SQL = EV.PUNCT.replace("'", "''")


def _cwords_sql(e: str) -> str:
    return (f"flatten(list_transform({_WORDS(e)}, lambda w: CASE WHEN length(w) = 1 THEN [w] "
            f"WHEN contains('{_PUNCT_SQL}', right(w, 1)) THEN [left(w, length(w) - 1), right(w, 1)] "
            f"WHEN contains('{_PUNCT_SQL}', left(w, 1)) THEN [left(w, 1), substr(w, 2)] ELSE [w] END))")


def _chrf_sql() -> str:
    orders = [("c", n, _cgrams_sql("hc", n), _cgrams_sql("rc", n)) for n in range(1, 7)]
    orders += [("w", n, _grams_sql("hw", n), _grams_sql("rw", n)) for n in range(1, 3)]
    tots = []
    for kind, n, _, _ in orders:
        hl, rl = ("length(hc)", "length(rc)") if kind == "c" else ("len(hw)", "len(rw)")
        tots.append(f"SELECT conv_id, turn, role, '{kind}' AS kind, {n} AS n, "
                    f"CASE WHEN {rl} - {n} + 1 > 0 THEN greatest({hl} - {n} + 1, 0) ELSE 0 END AS nh, "
                    f"greatest({rl} - {n} + 1, 0) AS nr FROM tok")
    tot = "\nUNION ALL ".join(tots)
    nows = lambda e: f"regexp_replace({e}, '{Q.WS}+', '', 'g')"
    return f"""
WITH pairs AS ({V.SQL['pairs']}),
tok AS (SELECT conv_id, turn, role, {nows('pred')} AS hc, {nows('ref')} AS rc,
               {_cwords_sql('pred')} AS hw, {_cwords_sql('ref')} AS rw FROM pairs),
m AS ({_match_sql(orders)}),
tot AS ({tot}),
corp AS (SELECT t.role, t.kind, t.n, sum(t.nh) AS nh, sum(t.nr) AS nr, sum(coalesce(m.m, 0)) AS m
         FROM tot t LEFT JOIN m ON t.conv_id = m.conv_id AND t.turn = m.turn AND t.kind = m.kind AND t.n = m.n
         GROUP BY t.role, t.kind, t.n),
agg AS (SELECT role, sum(CASE WHEN nh > 0 THEN m / nh ELSE 1e-16 END) AS sp,
               sum(CASE WHEN nr > 0 THEN m / nr ELSE 1e-16 END) AS sr,
               sum(CASE WHEN nh > 0 AND nr > 0 THEN 1 ELSE 0 END) AS e FROM corp GROUP BY role),
pr AS (SELECT role, CASE WHEN e = 0 THEN 0.0 ELSE sp / e END AS p, CASE WHEN e = 0 THEN 0.0 ELSE sr / e END AS r FROM agg)
SELECT role, round(CASE WHEN p + r > 0 THEN 100.0 * 5.0 * p * r / (4.0 * p + r) ELSE 0.0 END, 6) AS chrf FROM pr"""


@register("corpus_chrf", _chrf_sql())
def q_chrf(spark, sf):
    c = EV.corpus_chrf(V.pairs(spark, sf), "pred", "ref", ["conv_id", "turn"], ["role"])
    return c.select("role", r6("chrf").alias("chrf"))
