"""Queries: scalar text / array functions, paths, contexts, variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold.functions import paths as P
from tracefold.functions import text as T
from tracefold.operators import actions as A
from tracefold.operators import redundancy as R
from tracefold.operators.nullsafe import join_same
from tracefold.operators.sessions import cwd_track
from tracefold.operators.trajectories import bounded_history
from tracefold.plans import fixtures as V
from tracefold.plans import sqlfrag as Q
from tracefold.plans.fmt import r6
from tracefold.plans.registry import register
from tracefold.session import stored
from tracefold.sources.tables import table

# ------------------------------------------------------------------ SQL helpers

S_WORDS = lambda e: f"list_filter(regexp_split_to_array({e}, '{Q.WS}+'), lambda x: x <> '')"
S_COLLAPSE = lambda e: f"regexp_replace({e}, '{Q.WS}+', ' ', 'g')"
S_LINES = (lambda e: f"(CASE WHEN regexp_split_to_array({e}, '{Q.LB}')[-1] = '' THEN "  # noqa: E731
           f"regexp_split_to_array({e}, '{Q.LB}')[1:len(regexp_split_to_array({e}, '{Q.LB}')) - 1] "
           f"ELSE regexp_split_to_array({e}, '{Q.LB}') END)")
S_ARR2D = "list_transform(string_split(input, ';'), lambda c: string_split(c, ' '))"


def s_render(parts: str) -> str:
    return (f"(CASE WHEN len({parts}) = 0 THEN '/' WHEN {parts}[1] = '~' THEN array_to_string({parts}, '/') "
            f"ELSE '/' || array_to_string({parts}, '/') END)")


def s_resolve(spec: str, cwd: str) -> str:
    path = f"(CASE WHEN starts_with({spec}, '~/') THEN '/root/' || substr({spec}, 3) ELSE {spec} END)"
    pieces = f"string_split(regexp_replace({path}, '/+$', ''), '/')"
    start = (f"(CASE WHEN substr({path}, 1, 1) IN ('/', '~') THEN CAST([] AS VARCHAR[]) "
             f"ELSE list_filter(string_split({cwd}, '/'), lambda x: x <> '') END)")
    fold = (f"list_reduce({pieces}, lambda acc, p: CASE WHEN p = '..' THEN acc[1:greatest(len(acc) - 1, 0)] "
            f"WHEN p IN ('.', '') THEN acc WHEN p = '~' THEN ['~'] ELSE list_append(acc, p) END, {start})")
    return f"(CASE WHEN coalesce({spec}, '') = '' THEN {cwd} ELSE {s_render(fold)} END)"


def s_strip_env(e: str) -> str:
    return (f"array_to_string(list_filter({S_LINES(e)}, lambda ln: NOT (contains(ln, 'OLDPWD=') "
            f"OR contains(ln, '_='))), chr(10))")


# ------------------------------------------------------------------ strings

@register("strip_dynamic_env", f"SELECT doc_id, {s_strip_env('text')} AS stripped FROM documents")
def q_strip_env(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.strip_dynamic_env("text").alias("stripped"))


@register("squeeze_sequence", V.with_views(f"""
SELECT seq, {Q.strip(S_COLLAPSE(f"array_to_string(list_transform(list_filter(list_transform({S_ARR2D}, lambda cmd: list_filter(cmd, lambda a: coalesce(a, '') <> '')), lambda cmd: len(cmd) > 0), lambda cmd: array_to_string(cmd, ' ')), ' ; ')"))} || ' <eos>' AS squeezed
FROM traces""", "traces"))
def q_squeeze(spark, sf):
    t = V.traces(spark, sf)
    arr = F.transform(F.split("input", ";"), lambda c: F.split(c, " "))
    return t.select("seq", T.squeeze_sequence(arr, " <eos>").alias("squeezed"))


@register("flatten_obs", V.with_views(f"""
SELECT seq, {Q.strip(f"array_to_string(list_transform({S_ARR2D}, lambda cmd: {Q.strip('array_to_string(cmd, chr(32))')}), chr(10))")} AS flat
FROM traces""", "traces"))
def q_flatten(spark, sf):
    t = V.traces(spark, sf)
    arr = F.transform(F.split("input", ";"), lambda c: F.split(c, " "))
    return t.select("seq", T.flatten_obs(arr).alias("flat"))


@register("seq_key", V.with_views(f"""
SELECT seq, array_to_string(list_transform(string_split(input, ';'), lambda c: {Q.strip(S_COLLAPSE('c'))}), '|') AS key
FROM traces""", "traces"))
def q_seq_key(spark, sf):
    t = V.traces(spark, sf)
    return t.select("seq", F.array_join(T.seq_key(F.split("input", ";")), "|").alias("key"))


@register("resolve_path", V.with_views(f"""
SELECT session, ord, {s_resolve("split_part(cmd, ' ', -1)", "'/srv/' || session")} AS resolved,
       {s_resolve("split_part(cmd, ' ', -1)", "'~/' || session")} AS resolved_home
FROM cmds""", "cmds"))
def q_resolve_path(spark, sf):
    c = V.cmds(spark, sf)
    spec = F.element_at(F.split("cmd", " "), -1)
    return c.select("session", "ord",
                    P.resolve_path(spec, F.concat(F.lit("/srv/"), F.col("session"))).alias("resolved"),
                    P.resolve_path(spec, F.concat(F.lit("~/"), F.col("session"))).alias("resolved_home"))


_CD = (lambda cmd, cwd: f"(CASE WHEN string_split({cmd}, ' ')[1] = 'cd' AND split_part({cmd}, ' ', -1) <> '' "  # noqa: E731
       f"THEN {s_resolve(f'split_part({cmd}, chr(32), -1)', cwd)} ELSE {cwd} END)")


@register("cwd_track", V.with_views(f"""
SELECT c.session, c.ord, c.cmd, b.cwd AS cwd_before, a.cwd AS cwd_after
FROM c JOIN walk_rec b ON b.session = c.session AND b.rk = c.rk - 1
       JOIN walk_rec a ON a.session = c.session AND a.rk = c.rk""", "cmds", extra={
    "c": "SELECT session, ord, cmd, row_number() OVER (PARTITION BY session ORDER BY ord) AS rk FROM cmds",
    "walk_rec": f"""SELECT session, CAST(0 AS BIGINT) AS rk, '/' AS cwd FROM (SELECT DISTINCT session FROM c)
UNION ALL
SELECT c.session, c.rk, {_CD('c.cmd', 'w.cwd')} FROM walk_rec w JOIN c ON c.session = w.session AND c.rk = w.rk + 1"""}))
def q_cwd_track(spark, sf):
    # small blocks: the oracle check then exercises the multi-level (recursive) scan on real sessions
    return cwd_track(V.cmds(spark, sf), "session", "ord", "cmd", start_cwd="/", block=8)


@register("split_context", V.with_views(f"""
SELECT conv_id, turn, {T.CONTEXT_KEYS}[i] AS key, parts[i + 1] AS value
FROM (SELECT conv_id, turn, parts, unnest(range(1, least(len(parts) - 1, 8) + 1)) AS i
      FROM (SELECT conv_id, turn, string_split(CASE WHEN turn % 3 = 2
              THEN '<del>' || pwd_before || '<del>' || ls_before
              ELSE '<del>' || pwd_before || '<del>' || ls_before || '<del>' || env_before END, '<del>') AS parts
            FROM ctx))""", "ctx"))
def q_split_context(spark, sf):
    c = V.ctx(spark, sf)
    raw = F.when(F.col("turn") % 3 == 2,
                 F.concat(F.lit("<del>"), "pwd_before", F.lit("<del>"), "ls_before")) \
           .otherwise(F.concat(F.lit("<del>"), "pwd_before", F.lit("<del>"), "ls_before", F.lit("<del>"),
                               "env_before"))
    return c.select("conv_id", "turn", F.explode(T.split_context(raw)).alias("key", "value"))


@register("clean_exec_result", """
SELECT doc_id, CAST(length(text) AS INTEGER) AS output_len, md5(text) AS output_md5,
       CASE WHEN raw IN (137, 124) THEN 0 ELSE raw END AS exit_code,
       CASE WHEN raw = -1 THEN 'container_error' ELSE 'ok' END AS status
FROM (SELECT doc_id, text, CAST(n_chars % 300 AS INTEGER) - 1 AS raw FROM documents)""")
def q_clean_exec(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("output"),
                                             ((F.col("n_chars") % 300).cast("int") - 1).alias("exit_code"))
    c = A.clean_exec_result(d)
    return c.select("doc_id", F.length("output").alias("output_len"), F.md5("output").alias("output_md5"),
                    "exit_code", "status")


@register("validate_actions", """
SELECT conv_id, turn, CASE WHEN ex = 1 AND ng = 1 THEN 'exec_and_new_global'
  WHEN ex = 1 AND length(text) > 0 THEN 'exec_with_text' WHEN length(text) > 128 THEN 'text_too_long' END AS error,
  CAST(CASE WHEN (ex = 1 AND ng = 1) OR (ex = 1 AND length(text) > 0) OR length(text) > 128 THEN -10.0 ELSE 0.0 END AS DOUBLE) AS penalty
FROM (SELECT conv_id, turn, text, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS ex,
             CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END AS ng FROM conversations)""")
def q_validate_actions(spark, sf):
    c = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.col("text").alias("input_addition"),
        F.when(F.col("role") == "assistant", 1).otherwise(0).alias("exec_action"),
        F.when(F.col("turn") % 3 == 0, 1).otherwise(0).alias("new_global"))
    return A.validate_actions(c).select("conv_id", "turn", "error", "penalty")


@register("training_pairs", V.with_views("""
SELECT seq, array_to_string(string_split(input, ';')[2:len(string_split(input, ';'))], ';') AS source,
       output || context_value AS target FROM traces""", "traces"))
def q_training_pairs(spark, sf):
    return A.training_pairs(V.traces(spark, sf)).select("seq", "source", "target")


@register("select_nonredundant", V.with_views("""
SELECT seq, input FROM traces WHERE redundancy_score > 0.9""", "traces"))
def q_select_nonredundant(spark, sf):
    return A.select_nonredundant(V.traces(spark, sf)).select("seq", "input")


@register("snapshot_name", """
SELECT doc_id, CASE WHEN n_chars >= 1000000 THEN CAST(floor(n_chars / 1000000) AS BIGINT) || 'M'
  WHEN n_chars >= 1000 THEN CAST(floor(n_chars / 1000) AS BIGINT) || 'K'
  WHEN n_chars >= 1 THEN CAST(n_chars AS VARCHAR) END AS name FROM documents""")
def q_snapshot_name(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.human_format("n_chars").alias("name"))


@register("pad_encode", f"""
SELECT conv_id, turn, CAST(n AS INTEGER) AS length, array_to_string(list_transform(padded, lambda x: CAST(x AS VARCHAR)), ',') AS ids,
  CAST(list_sum(list_transform(padded, lambda x, i: CASE WHEN i <= n THEN 1 ELSE 0 END)) AS BIGINT) AS mask_sum,
  array_to_string(list_transform(padded, lambda x, i: CAST(CASE WHEN i <= n THEN x ELSE -100 END AS VARCHAR)), ',') AS labels
FROM (SELECT conv_id, turn, len(cut) AS n, list_concat(cut, list_transform(range(0, greatest(128 - len(cut), 0)), lambda x: 0)) AS padded
      FROM (SELECT conv_id, turn, list_transform({S_WORDS('text')}, lambda w: CAST(length(w) AS INTEGER)) AS cut
            FROM conversations))""")
def q_pad_encode(spark, sf):
    c = table(spark, sf, "conversations")
    c = c.withColumn("_w", A.words("text")).withColumn("ids", F.transform("_w", lambda w: F.length(w)))
    p = A.pad_encode(c, "ids", 128, out="p")
    return p.select("conv_id", "turn", F.col("p.length").alias("length"),
                    F.array_join(F.transform("p.ids", lambda x: x.cast("string")), ",").alias("ids"),
                    F.aggregate("p.mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("mask_sum"),
                    F.array_join(F.transform("p.labels", lambda x: x.cast("string")), ",").alias("labels"))


@register("masked_policy", """
SELECT vec_id, round(z[a + 1] - lse, 6) AS logp,
       round(-list_sum(list_transform(z, lambda x: exp(x - lse) * (x - lse))), 6) AS entropy
FROM (SELECT vec_id, z, a, mx + ln(list_sum(list_transform(z, lambda x: exp(x - mx)))) AS lse
  FROM (SELECT vec_id, z, a, list_max(z) AS mx
    FROM (SELECT vec_id, label % 64 AS a, list_transform(embedding, lambda x, i:
            CASE WHEN (i - 1 + vec_id) % 3 <> 0 THEN CAST(x AS DOUBLE) ELSE -1e5 END) AS z FROM embeddings)))""")
def q_masked_policy(spark, sf):
    e = table(spark, sf, "embeddings")
    mask = F.transform("embedding", lambda x, i: F.when((i + F.col("vec_id")) % 3 != 0, 1).otherwise(0))
    e = e.withColumn("mask", mask).withColumn("action", F.col("label") % 64)
    m = A.masked_policy(e, "embedding", "mask", "action", out="m")
    return m.select("vec_id", r6("m.logp").alias("logp"), r6("m.entropy").alias("entropy"))


# ------------------------------------------------------------------ contexts

def _snapshots(c):
    before = R.snapshot(pwd=F.col("pwd_before"), ls=F.col("ls_before"), env=F.col("env_before"))
    after_all = R.snapshot(pwd=F.col("pwd_after"), ls=F.col("ls_after"), env=F.col("env_after"))
    after_short = R.snapshot(pwd=F.col("pwd_after"), env=F.col("env_after"))
    after = F.when(F.col("conv_id") % 5 == 0, after_short).otherwise(after_all)
    return before, after


def s_compare(bp, bl, be, ap, al, ae):
    """(same, key, after_value) of the first differing / missing key."""
    key = (f"CASE WHEN {bp} <> {ap} THEN 'pwd' WHEN {al} IS NULL THEN 'error' WHEN {bl} <> {al} THEN 'ls' "
           f"WHEN {s_strip_env(be)} <> {s_strip_env(ae)} THEN 'env' ELSE 'none' END")
    val = (f"CASE WHEN {bp} <> {ap} THEN {ap} WHEN {al} IS NULL THEN NULL WHEN {bl} <> {al} THEN {al} "
           f"WHEN {s_strip_env(be)} <> {s_strip_env(ae)} THEN {s_strip_env(ae)} END")
    return key, val


_K, _VAL = s_compare("pwd_before", "ls_before", "env_before", "pwd_after",
                     "CASE WHEN conv_id % 5 = 0 THEN NULL ELSE ls_after END", "env_after")


@register("context_compare", V.with_views(f"""
SELECT conv_id, turn, k IN ('none', 'error') AS same, k AS key FROM (SELECT conv_id, turn, {_K} AS k FROM ctx)""",
                                          "ctx"))
def q_context_compare(spark, sf):
    c = V.ctx(spark, sf)
    before, after = _snapshots(c)
    r = c.select("conv_id", "turn", R.context_compare(before, after).alias("cmp"))
    return r.select("conv_id", "turn", F.col("cmp.same").alias("same"), F.col("cmp.key").alias("key"))


@register("context_line_delta", V.with_views(f"""
SELECT conv_id, turn, line, CASE WHEN nb > na THEN '-' ELSE '+' END AS change, CAST(abs(nb - na) AS BIGINT) AS n
FROM (SELECT conv_id, turn, line, sum(CASE WHEN side < 0 THEN 1 ELSE 0 END) AS nb,
             sum(CASE WHEN side > 0 THEN 1 ELSE 0 END) AS na
      FROM (SELECT conv_id, turn, unnest({S_LINES('pred')}) AS line, -1 AS side FROM pairs
            UNION ALL SELECT conv_id, turn, unnest({S_LINES('ref')}) AS line, 1 AS side FROM pairs)
      GROUP BY conv_id, turn, line) WHERE nb <> na""", "pairs"))
def q_context_line_delta(spark, sf):
    return R.context_line_delta(V.pairs(spark, sf), ["conv_id", "turn"], "pred", "ref")


_K2, _V2 = s_compare("f.pwd_before", "f.ls_before", "f.env_before", "v.pwd_after",
                     "CASE WHEN v.conv_id % 5 = 0 THEN NULL ELSE v.ls_after END", "v.env_after")
_KF, _VF = s_compare("pwd_before", "ls_before", "env_before", "pwd_after",
                     "CASE WHEN conv_id % 5 = 0 THEN NULL ELSE ls_after END", "env_after")


@register("context_redundancy", V.with_views(f"""
SELECT conv_id, context_same, context_key, n_args, n_redundant,
       round(CASE WHEN n_args = 0 THEN 0.5 ELSE 1.0 - n_redundant / n_args END, 6) AS context_redundancy_score
FROM (SELECT f.conv_id, f.fk IN ('none', 'error') AS context_same, f.fk AS context_key,
        CAST(count(v.conv_id) AS BIGINT) AS n_args,
        CAST(CASE WHEN f.fk IN ('none', 'error') THEN count(v.conv_id)
             ELSE sum(CASE WHEN v.conv_id IS NOT NULL AND {_K2} = f.fk
                      AND coalesce({_V2} = f.fv, {_V2} IS NULL AND f.fv IS NULL) THEN 1 ELSE 0 END) END AS BIGINT) AS n_redundant
      FROM (SELECT *, {_KF} AS fk, {_VF} AS fv FROM ctx WHERE turn = 0) f
      LEFT JOIN (SELECT * FROM ctx WHERE turn >= 1) v ON f.conv_id = v.conv_id
      GROUP BY f.conv_id, f.fk, f.fv)""", "ctx"))
def q_context_redundancy(spark, sf):
    c = V.ctx(spark, sf)
    before, after = _snapshots(c)
    snaps = c.select("conv_id", "turn", before.alias("before"), after.alias("after"))
    full = snaps.where(F.col("turn") == 0)
    var = snaps.where(F.col("turn") >= 1).select("conv_id", "after")
    r = R.context_redundancy(full, var, "conv_id")
    return r.select("conv_id", "context_same", "context_key", F.col("n_args").cast("bigint").alias("n_args"),
                    F.col("n_redundant").cast("bigint").alias("n_redundant"),
                    r6("context_redundancy_score").alias("context_redundancy_score"))


# ------------------------------------------------------------------ variants and memo

def _sequences(spark, sf):
    """(seq, earlier, args): each trace's whole command sequence as the
    digest of its earlier commands and the tokens of its last one.  Stored
    before any filter: a filter on these columns would be pushed below and cut
    up every text again."""
    flat = F.regexp_replace("input", f"{A.WS_CLASS}+", " ")
    cmds = F.filter(F.transform(F.split(flat, ";"), lambda c: F.trim(c)), lambda c: c != "")
    t = V.traces(spark, sf).select("seq", cmds.alias("_cmds"))
    earlier, args = R.sequence_parts(F.col("_cmds"))
    return stored(t.select("seq", earlier.alias("earlier"), args.alias("args")), "sequences").where("args is not null")


_SQL_SEQUENCES = f"""
SELECT seq, sha256(array_to_string(cmds[1:len(cmds) - 1], ' ; ')) AS earlier, string_split(cmds[-1], ' ') AS toks
FROM (SELECT seq, list_filter(list_transform(string_split({S_COLLAPSE("input")}, ';'), lambda c: trim(c)), lambda c: c <> '') AS cmds FROM traces)
WHERE len(cmds) >= 1"""
_SQL_VARIANTS = """
SELECT seq, pos AS dropped_pos, earlier, array_to_string(list_concat(toks[1:pos], toks[pos + 2:len(toks)]), ' ') AS key
FROM (SELECT seq, earlier, toks, unnest(range(1, len(toks))) AS pos FROM seqs WHERE len(toks) >= 2)"""
_SQL_WHOLE = "SELECT seq, 0 AS dropped_pos, earlier, array_to_string(toks, ' ') AS key FROM seqs"


@register("leave_one_out", V.with_views("SELECT seq, CAST(dropped_pos AS INTEGER) AS dropped_pos, earlier, key FROM v",
                                        "traces", extra={"seqs": _SQL_SEQUENCES, "v": _SQL_VARIANTS}))
def q_leave_one_out(spark, sf):
    v = R.leave_one_out(_sequences(spark, sf), "args")
    return v.select("seq", "dropped_pos", "earlier", F.array_join("variant", " ").alias("key"))


def _memo(sequences):
    """The memo of known runs: every trace is a stored run of its whole
    sequence."""
    return sequences.select(R.sequence_key("earlier", "args").alias("key"), F.col("seq").alias("run_no"))


def _variant_text(found, sequences):
    """Add the texts to rows with (seq, dropped_pos); 0: nothing dropped."""
    p, n = F.col("dropped_pos"), F.size("args")
    short = F.concat(F.slice("args", F.lit(1), p), F.slice("args", p + 2, n - p - 1))
    text = F.array_join(F.when(p == 0, F.col("args")).otherwise(short), " ")
    return found.join(sequences, "seq").withColumn("key", text).drop("args")


@register("pending_runs", V.with_views("""
SELECT DISTINCT earlier, key FROM v WHERE (earlier, key) NOT IN (SELECT (earlier, key) FROM memo)""", "traces",
                                       extra={"seqs": _SQL_SEQUENCES, "v": _SQL_VARIANTS, "memo": _SQL_WHOLE}))
def q_pending_runs(spark, sf):
    sequences = _sequences(spark, sf)
    v = R.variant_keys(sequences, "seq", "earlier", "args")
    first = v.groupBy("key").agg(F.min(F.struct("seq", "dropped_pos")).alias("_v")).select("key", "_v.*")
    todo = join_same(first, _memo(sequences), ["key"], "left_anti")
    return _variant_text(todo.select("seq", "dropped_pos"), sequences).select("earlier", "key")


@register("memo_lookup", V.with_views("""
SELECT req, key, arg_min(run_no, md5(concat_ws('|', '7', req, CAST(run_no AS VARCHAR)))) AS run_no
FROM (SELECT v.seq || ':' || v.dropped_pos AS req, v.key, m.seq AS run_no
      FROM (SELECT * FROM v UNION ALL SELECT * FROM whole) v JOIN mh m ON v.key = m.key AND v.earlier = m.earlier)
GROUP BY req, key""", "traces", extra={"seqs": _SQL_SEQUENCES, "v": _SQL_VARIANTS, "whole": _SQL_WHOLE, "mh": """
SELECT * FROM whole QUALIFY row_number() OVER (PARTITION BY earlier, key ORDER BY seq DESC) <= 5"""}))
def q_memo_lookup(spark, sf):
    """Requests: every whole sequence and each of its variants."""
    sequences = _sequences(spark, sf)
    whole = _memo(sequences)
    v = R.variant_keys(sequences, "seq", "earlier", "args")
    v = v.unionByName(whole.select(F.col("run_no").alias("seq"), F.lit(0).alias("dropped_pos"), "key"))
    v = v.withColumn("req", F.concat_ws(":", F.col("seq").cast("string"), F.col("dropped_pos").cast("string")))
    m = R.memo_lookup(v.select("req", "key"), bounded_history(whole, "key", "run_no", n=5), key="key", req_id="req", seed=7).select("req", "run_no")
    at = F.split("req", ":")
    m = m.withColumn("seq", at[0].cast("long")).withColumn("dropped_pos", at[1].cast("int"))
    return _variant_text(m, sequences).select("req", "key", "run_no")


@register("exclude_known_inputs", V.with_views("""
SELECT seq FROM traces WHERE input IS NULL AND NOT EXISTS (SELECT 1 FROM traces t JOIN labels l ON t.seq = l.doc_id WHERE t.input IS NULL)
UNION ALL SELECT seq FROM traces WHERE input NOT IN (SELECT t.input FROM traces t JOIN labels l ON t.seq = l.doc_id WHERE t.input IS NOT NULL)""", "traces"))
def q_exclude_known(spark, sf):
    """Known inputs: the whole inputs of the labelled traces."""
    from tracefold.operators.curation import exclude_known_inputs
    t = V.traces(spark, sf).select("seq", "input")
    known = t.join(table(spark, sf, "labels").select(F.col("doc_id").alias("seq")), "seq", "left_semi")
    return exclude_known_inputs(t, known).select("seq")
