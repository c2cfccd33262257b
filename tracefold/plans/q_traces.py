"""Queries: output normalisation, the similarity/redundancy chain and trace scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold.functions import text as T
from tracefold.functions.similarity import indel_similarity
from tracefold.operators import redundancy as R
from tracefold.operators.scoring import score_traces
from tracefold.plans import fixtures as V
from tracefold.plans import sqlfrag as Q
from tracefold.plans.fmt import r6
from tracefold.plans import q_text  # noqa: F401  (context redundancy is registered there)
from tracefold.plans.registry import REGISTRY, register
from tracefold.session import cut_lineage
from tracefold.sources.tables import table


def last_command_args(input_col: str = "input"):
    """Arguments of the last command of an input line: whitespace tokens
    of the last ';' segment, utility excluded."""
    last = T.py_strip(F.element_at(F.split(F.col(input_col), ";"), -1))
    toks = F.filter(F.split(last, f"{T.WS_CLASS}+"), lambda x: x != "")
    return toks


SQL_LAST_TOKS = (f"list_filter(regexp_split_to_array({Q.strip('split_part(input, chr(59), -1)')}, "
                 f"'{Q.WS}+'), lambda x: x <> '')")


@register("normalise_output", V.with_views(f"""
SELECT seq, {Q.normalise('output')} AS normalised FROM traces""", "traces"))
def q_normalise_output(spark, sf):
    t = V.traces(spark, sf)
    return t.select("seq", T.normalise_output("output").alias("normalised"))


_SQL_TEXT_PAIRS = "SELECT conv_id || ':' || turn AS pid, conv_id, turn, coalesce(pred, '') AS a, coalesce(ref, '') AS b FROM pairs"


@register("indel_similarity", V.with_views("SELECT t.conv_id, t.turn, round(s.sim, 6) AS sim FROM tp t JOIN sims s ON s.pid = t.pid",
                                           "pairs", extra={"tp": _SQL_TEXT_PAIRS, **Q.indel("tp")}))
def q_indel_similarity(spark, sf):
    p = V.pairs(spark, sf)
    return p.select("conv_id", "turn", r6(indel_similarity("pred", "ref")).alias("sim"))


_SQL_RUN_PAIRS = {
    "nr": f"SELECT k, run_no, exit_code, {Q.normalise('output')} AS norm FROM runs",
    "rp": """SELECT x.k || ':' || x.run_no || ':' || y.run_no AS pid, x.k, x.run_no AS run_i, y.run_no AS run_j, x.norm AS a, y.norm AS b,
             x.exit_code AS code_i, y.exit_code AS code_j FROM nr x JOIN nr y ON x.k = y.k AND x.run_no < y.run_no""",
    **Q.indel("rp"),
    "ps": "SELECT rp.*, s.sim FROM rp JOIN sims s ON s.pid = rp.pid",
}
_SQL_NOISE = {
    **_SQL_RUN_PAIRS,
    "beta": """
SELECT k, n_runs, n_pairs, beta0, greatest(0.2, beta0 - 0.05) AS beta FROM (
  SELECT r.k, r.n_runs, coalesce(p.n_pairs, 0) AS n_pairs,
         CASE WHEN r.n_runs < 2 THEN 1.0 ELSE greatest(0.2, p.m - coalesce(p.s, 0.0)) END AS beta0
  FROM (SELECT k, count(*) AS n_runs FROM runs GROUP BY k) r
  LEFT JOIN (SELECT k, count(*) AS n_pairs, avg(sim) AS m, stddev_samp(sim) AS s FROM ps GROUP BY k) p ON p.k = r.k)""",
}


@register("pairwise_run_similarity", V.with_views("SELECT k, run_i, run_j, round(sim, 6) AS sim FROM ps", "runs", extra=_SQL_RUN_PAIRS))
def q_pairwise(spark, sf):
    r = R.pairwise_run_similarity(V.runs(spark, sf), key="k")
    return r.select("k", "run_i", "run_j", r6("sim").alias("sim"))


@register("noise_threshold", V.with_views("""
SELECT k, CAST(n_runs AS BIGINT) AS n_runs, CAST(n_pairs AS BIGINT) AS n_pairs, round(beta0, 6) AS beta0, round(beta, 6) AS beta FROM beta""",
                                          "runs", extra=_SQL_NOISE))
def q_noise(spark, sf):
    b = R.noise_threshold(V.runs(spark, sf), key="k")
    return b.select("k", F.col("n_runs").cast("bigint").alias("n_runs"),
                    F.col("n_pairs").cast("bigint").alias("n_pairs"),
                    r6("beta0").alias("beta0"), r6("beta").alias("beta"))


def _chain(spark, sf):
    """Repeat runs of one key stand for the noise runs (all) and for
    the reference (run 1) plus its leave-one-out variants (runs >= 2).
    beta is rounded, so that both engines compare with the same number."""
    runs = V.runs(spark, sf)
    pairs = cut_lineage(R.pairwise_run_similarity(runs, key="k"))  # one LCS a pair: the threshold and the variants read it
    beta = R.noise_threshold(runs, key="k", pairs=pairs).select("k", r6("beta").alias("beta"))
    ref = runs.where(F.col("run_no") == 1).join(beta, "k")
    var = runs.where(F.col("run_no") >= 2)
    known = pairs.where("run_i = 1").select("k", F.col("run_j").alias("run_no"), "sim")
    return R.variant_vs_reference(var, ref, key="k", known=known), ref


_SQL_CHAIN = {
    **_SQL_NOISE,
    "cmpd": """SELECT k, run_no, code_match, CASE WHEN code_match THEN sim END AS sim, beta, code_match AND sim + 1e-12 >= beta AS redundant
      FROM (SELECT p.k, p.run_j AS run_no, p.code_i = p.code_j AS code_match, p.sim, round(b.beta, 6) AS beta
            FROM ps p JOIN beta b ON b.k = p.k WHERE p.run_i = 1)""",
}


@register("variant_vs_reference", V.with_views("""
SELECT k, run_no, code_match, round(sim, 6) AS sim, beta, coalesce(redundant, false) AS redundant FROM cmpd""", "runs", extra=_SQL_CHAIN))
def q_variant_vs_reference(spark, sf):
    c, _ = _chain(spark, sf)
    return c.select("k", "run_no", "code_match", r6("sim").alias("sim"), "beta", F.coalesce("redundant", F.lit(False)).alias("redundant"))


_SQL_OUTPUT = V.with_views("""
SELECT k, CAST(n AS BIGINT) AS n_args, CAST(r AS BIGINT) AS n_redundant, round(CASE WHEN n = 0 THEN 0.5 ELSE 1.0 - r / n END, 6) AS output_redundancy_score
FROM (SELECT f.k, count(c.k) AS n, coalesce(sum(CASE WHEN c.redundant THEN 1 ELSE 0 END), 0) AS r
      FROM (SELECT DISTINCT k FROM runs WHERE run_no = 1) f LEFT JOIN cmpd c ON c.k = f.k GROUP BY f.k)""", "runs", extra=_SQL_CHAIN)


@register("output_redundancy", _SQL_OUTPUT)
def q_output_redundancy(spark, sf):
    c, ref = _chain(spark, sf)
    o = R.output_redundancy(c, key="k", references=ref)
    return o.select("k", F.col("n_args").cast("bigint").alias("n_args"),
                    F.col("n_redundant").cast("bigint").alias("n_redundant"),
                    r6("output_redundancy_score").alias("output_redundancy_score"))


@register("score_traces", f"""
WITH outs AS ({_SQL_OUTPUT}), ctxs AS ({REGISTRY["context_redundancy"].sql}),
cmd AS (SELECT conv_id, CAST(greatest(len({SQL_LAST_TOKS}) - 1, 0) AS BIGINT) AS n_args, (conv_id + turn) % 7 <> 3 AS ok
        FROM (SELECT conv_id, turn, coalesce(text, '') AS input FROM conversations WHERE turn = 0)),
sc AS (SELECT cmd.conv_id, n_args, ok, coalesce(x.context_key, 'none') AS ck,
         CASE WHEN NOT ok THEN 0.0 WHEN cmd.n_args = 0 THEN 0.5 ELSE coalesce(o.output_redundancy_score, 0.5) END AS o,
         CASE WHEN NOT ok THEN 0.0 WHEN cmd.n_args = 0 THEN 0.5 ELSE coalesce(x.context_redundancy_score, 0.5) END AS c
       FROM (SELECT conv_id, n_args, ok FROM cmd) cmd LEFT JOIN (SELECT k, output_redundancy_score FROM outs) o ON o.k = 'conv/' || cmd.conv_id
       LEFT JOIN (SELECT conv_id, context_key, context_redundancy_score FROM ctxs) x ON x.conv_id = cmd.conv_id)
SELECT conv_id, n_args, CAST(CASE WHEN ok THEN 1.0 ELSE -1.0 END AS DOUBLE) AS exit_score,
  round(o, 6) AS output_redundancy_score, round(c, 6) AS context_redundancy_score, round(greatest(o, c), 6) AS redundancy_score,
  CASE WHEN ok THEN ck ELSE 'none' END AS context_key,
  round(n_args / 14.0 * (greatest(o, c) - 0.5) + CASE WHEN ok THEN 0.0 ELSE -1.0 END, 6) AS reward FROM sc""")
def q_score_traces(spark, sf):
    """The whole chain: each conversation's first turn is the command, its
    turns are the runs (output score) and its turn pairs the contexts
    (context score and key)."""
    t = table(spark, sf, "conversations").where("turn = 0").select(
        "conv_id", F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("k"), F.coalesce("text", F.lit("")).alias("input"),
        F.when((F.col("conv_id") + F.col("turn")) % 7 == 3, 1).otherwise(0).alias("exit_code"))
    t = t.withColumn("n_args", F.greatest(F.size(last_command_args()) - 1, F.lit(0)).cast("bigint"))
    out = q_output_redundancy(spark, sf).select("k", "output_redundancy_score")
    ctx = REGISTRY["context_redundancy"].fn(spark, sf).select("conv_id", "context_key", "context_redundancy_score")
    t = t.join(out, "k", "left").join(ctx, "conv_id", "left")
    t = t.fillna({"output_redundancy_score": 0.5, "context_redundancy_score": 0.5, "context_key": "none"})
    s = score_traces(t, margin=0.5, local_horizon=13, mode="final")
    return s.select("conv_id", "n_args", "exit_score", r6("output_redundancy_score").alias("output_redundancy_score"),
                    r6("context_redundancy_score").alias("context_redundancy_score"), r6("redundancy_score").alias("redundancy_score"),
                    "context_key", r6("reward").alias("reward"))


def flagship(spark, sf):
    """Noise threshold -> variants -> output redundancy, context redundancy -> scores."""
    return q_score_traces(spark, sf)
