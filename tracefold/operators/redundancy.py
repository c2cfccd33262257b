"""Argument-redundancy chain: leave-one-out variants, memo joins, noise
threshold from repeat runs, variant-vs-reference and context comparison.

Everything is joins, aggregates and array expressions; the only Python
is the indel similarity, which sees whole, code-filtered text.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.functions.similarity import indel_similarity, similar_at_least
from tracefold.functions.text import CONTEXT_KEYS, normalise_output, strip_dynamic_env
from tracefold.operators.nullsafe import join_same

Similarity = Callable[[Column, Column], Column]


def leave_one_out(df: DataFrame, args_col: str = "args", out: str = "variant",
                  pos: str = "dropped_pos") -> DataFrame:
    """n-1 variants of an n-token command, each without one argument;
    position 0 (the utility) is never dropped.  Guard n < 2 first:
    ``sequence(1, 0)`` would count down."""
    args = F.col(args_col)
    n = F.size(args)
    p = F.col(pos)
    return (df.where(n >= 2)
              .withColumn(pos, F.explode(F.sequence(F.lit(1), n - 1)))
              .withColumn(out, F.concat(F.slice(args, F.lit(1), p),
                                        F.slice(args, p + 2, n - p - 1))))


def sequence_parts(commands: Column) -> tuple[Column, Column]:
    """(digest of the earlier commands, tokens of the last one) of a command
    sequence: an array of whitespace-normalised, non-empty commands."""
    n = F.size(commands)
    earlier = F.sha2(F.array_join(F.slice(commands, F.lit(1), n - 1), " ; "), 256)
    return F.when(n >= 1, earlier), F.when(n >= 1, F.split(F.try_element_at(commands, F.lit(-1)), " "))


#: Two seeds make 128 bits.
_SEEDS = (1, 2)


def _token_hash(index: Column, token: Column, seed: int) -> Column:
    return F.xxhash64(index.cast("int"), token, F.lit(seed))


def _key(earlier: Column, n: Column, marks: list[Column]) -> Column:
    return F.concat_ws(":", earlier, n.cast("string"), *[F.hex(m) for m in marks])


def sequence_key(earlier: str, args: str) -> Column:
    """Memo key of a whole sequence: earlier commands, token count and the
    xor of the last command's (place, token) hashes."""
    a = F.col(args)
    marks = [F.aggregate(F.transform(a, lambda x, i: _token_hash(i, x, s)), F.lit(0).cast("long"), lambda m, x: m.bitwiseXOR(x)) for s in _SEEDS]
    return F.when(a.isNotNull(), _key(F.col(earlier), F.size(a), marks))


def variant_keys(df: DataFrame, row: str, earlier: str, args: str, pos: str = "dropped_pos", key: str = "key") -> DataFrame:
    """(row, pos, key): the memo key of every leave-one-out variant, without
    building the variant.  A variant keeps the tokens before ``pos`` in
    their places and moves those after it one place down, so its key is the
    running xor of the tokens' hashes in place before ``pos`` and of their
    hashes one place down after it.  Equal to ``sequence_key`` of the
    variant's tokens; a row costs one row per token."""
    a = F.col(args)
    n = F.size(a)
    moved = [F.aggregate(F.transform(a, lambda x, i: _token_hash(i - 1, x, s)), F.lit(0).cast("long"), lambda m, x: m.bitwiseXOR(x)) for s in _SEEDS]
    # the sums of a row before its tokens are spread: beside the generator they would be computed for each token
    rows = df.where(n >= 2).select(row, F.col(earlier).alias("_earlier"), n.alias("_n"), *[m.alias(f"_all{s}") for s, m in zip(_SEEDS, moved)], a.alias("_args"))
    rows = rows.select(row, "_earlier", "_n", *[f"_all{s}" for s in _SEEDS], F.posexplode("_args").alias(pos, "_token"))
    before = Window.partitionBy(row).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    through = Window.partitionBy(row).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(row, pos, "_earlier", "_n", *[f"_all{s}" for s in _SEEDS],
                       *[_token_hash(F.col(pos), F.col("_token"), s).alias(f"_here{s}") for s in _SEEDS],
                       *[_token_hash(F.col(pos) - 1, F.col("_token"), s).alias(f"_down{s}") for s in _SEEDS])
    marks = [F.coalesce(F.bit_xor(f"_here{s}").over(before), F.lit(0).cast("long")).bitwiseXOR(F.col(f"_all{s}")).bitwiseXOR(F.bit_xor(f"_down{s}").over(through)) for s in _SEEDS]
    return rows.select(row, pos, _key(F.col("_earlier"), F.col("_n") - 1, marks).alias(key)).where(F.col(pos) >= 1)


def pending_runs(variants: DataFrame, results: DataFrame, key: str = "key") -> DataFrame:
    """Variant keys not yet in the results memo: they still need a run."""
    todo = variants.select(key).distinct()
    return join_same(todo, results.select(key), [key], "left_anti")


def memo_lookup(requests: DataFrame, results: DataFrame, key: str, req_id: str,
                run_col: str = "run_no", seed: int = 0) -> DataFrame:
    """For each request whose key is known, one stored run chosen by a
    seeded hash (keeps the run-to-run noise of the memo).  Results per
    key are bounded by the memo size (``bounded_history``)."""
    pick = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(req_id).cast("string"),
                             F.col(run_col).cast("string")))
    j = requests.select(req_id, key).join(results, on=key, how="inner")
    chosen = F.min_by(F.struct(*[F.col(c) for c in results.columns if c != key]), pick)
    return j.groupBy(req_id, key).agg(chosen.alias("run")).select(req_id, key, "run.*")


def pairwise_run_similarity(runs: DataFrame, key: str = "k", run: str = "run_no",
                            text: str = "output", sim: Similarity = indel_similarity) -> DataFrame:
    """All i<j pairs of normalised outputs among the repeat runs of one
    command.  The pairs are the feature; a command is run a configured,
    small number of times, so a key holds few rows."""
    r = runs.select(key, run, normalise_output(text).alias("norm"))
    a, b = r.alias("a"), r.alias("b")
    pairs = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}"))
                   & (F.col(f"a.{run}") < F.col(f"b.{run}")))
    return pairs.select(F.col(f"a.{key}").alias(key), F.col(f"a.{run}").alias("run_i"),
                        F.col(f"b.{run}").alias("run_j"),
                        sim(F.col("a.norm"), F.col("b.norm")).alias("sim"))


def noise_threshold(runs: DataFrame, key: str = "k", run: str = "run_no",
                    text: str = "output", k: float = 1.0, margin: float = 0.05,
                    floor: float = 0.2, sim: Similarity = indel_similarity, pairs: DataFrame | None = None) -> DataFrame:
    """``pairs``: the pair similarities, where they are there already.
    beta0 = max(floor, mean - k * sample std) over the pair similarities
    of all repeat runs of a command (std 0 for one pair; fewer than two
    runs -> 1.0); beta = max(floor, beta0 - margin)."""
    pairs = pairwise_run_similarity(runs, key, run, text, sim) if pairs is None else pairs
    stats = pairs.groupBy(key).agg(F.count("*").alias("n_pairs"), F.avg("sim").alias("mean_sim"),
                                   F.stddev_samp("sim").alias("std_sim"))
    keys = runs.groupBy(key).agg(F.count("*").alias("n_runs"))
    beta0 = F.when(F.col("n_runs") < 2, F.lit(1.0)).otherwise(
        F.greatest(F.lit(floor), F.col("mean_sim") - F.lit(k) * F.coalesce(F.col("std_sim"), F.lit(0.0))))
    return (keys.join(stats, on=key, how="left")
                .select(key, "n_runs", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"),
                        beta0.alias("beta0"))
                .withColumn("beta", F.greatest(F.lit(floor), F.col("beta0") - F.lit(margin))))


def variant_vs_reference(variants: DataFrame, reference: DataFrame, key: str,
                         beta_col: str = "beta", text: str = "output", code: str = "exit_code",
                         sim: Similarity | None = indel_similarity, known: DataFrame | None = None, run: str = "run_no") -> DataFrame:
    """A variant is redundant iff its exit code equals the reference code
    and the similarity of normalised outputs is >= beta.  Rows whose code
    differs hand empty text to the similarity, so no LCS runs for them.

    ``known`` (key, run, sim): similarities to the reference that are there
    already; nothing is computed then.  ``sim=None``: only whether beta is
    reached, by bounds and a recurrence that stops early; no ``sim`` column."""
    ref = reference.select(key, F.col(text).alias("_ref_text"), F.col(code).alias("_ref_code"),
                           beta_col)
    j = variants.join(ref, on=key, how="inner")
    match = F.col(code) == F.col("_ref_code")
    mine, theirs = (F.when(match, normalise_output(c)).otherwise(F.lit("")) for c in (text, "_ref_text"))
    if known is not None:
        j = join_same(j, known.select(key, run, F.col("sim").alias("_sim")), [key, run], "left")
        j = j.withColumn("code_match", match).withColumn("sim", F.when(match, F.col("_sim"))).drop("_sim")
    elif sim is None:
        j = j.withColumn("_a", mine).withColumn("_b", theirs).withColumn("code_match", match)
        j = j.withColumn("redundant", match & similar_at_least("_a", "_b", beta_col)).drop("_a", "_b")
        return j.drop("_ref_text", "_ref_code")
    else:
        j = j.withColumn("code_match", match).withColumn("sim", F.when(match, sim(mine, theirs)))
    return j.withColumn("redundant", match & (F.col("sim") >= F.col(beta_col))).drop("_ref_text", "_ref_code")


def output_redundancy(compared: DataFrame, key: str, references: DataFrame | None = None) -> DataFrame:
    """score = 1 - n_redundant / n_args.  With ``references`` every command
    in it has a row; one without arguments has nothing to compare and
    scores 0.5 (the bare-command value)."""
    agg = compared.groupBy(key).agg(F.count("*").alias("n_args"),
                                    F.sum(F.col("redundant").cast("int")).alias("n_redundant"))
    if references is not None:
        agg = references.select(key).distinct().join(agg, key, "left")
        agg = agg.withColumn("n_args", F.coalesce("n_args", F.lit(0))).withColumn("n_redundant", F.coalesce("n_redundant", F.lit(0)))
    score = F.when(F.col("n_args") == 0, F.lit(0.5)).otherwise(
        1.0 - F.col("n_redundant") / F.col("n_args"))
    return agg.withColumn("output_redundancy_score", score)


# ---------------------------------------------------------------- context

def snapshot(**cols: Column) -> Column:
    """Map of context key -> text, for the keys given (any order)."""
    kv = []
    for k, c in cols.items():
        kv += [F.lit(k), c]
    return F.create_map(*kv)


def context_compare(before: Column, after: Column) -> Column:
    """struct(same, key, before_value, after_value) of the first key, in
    baseline key order, that differs or is missing after.  Missing ->
    (true, 'error'); none -> (true, 'none').  env is compared with its
    dynamic lines stripped.  The two values are kept: ``context_line_delta``
    gives their changed lines."""
    items = []
    for pos, k in enumerate(CONTEXT_KEYS):
        b = before[k]
        a = after[k]
        if k == "env":
            b, a = strip_dynamic_env(b), strip_dynamic_env(a)
        status = (F.when(b.isNull(), F.lit("absent"))
                   .when(a.isNull(), F.lit("missing"))
                   .when(b != a, F.lit("diff"))
                   .otherwise(F.lit("same")))
        items.append(F.struct(F.lit(pos).alias("pos"), F.lit(k).alias("key"), status.alias("status"),
                              b.alias("b"), a.alias("a")))
    hits = F.filter(F.array(*items), lambda x: x["status"].isin("diff", "missing"))
    first = F.element_at(hits, 1)
    return (F.when(F.size(hits) == 0,
                   F.struct(F.lit(True).alias("same"), F.lit("none").alias("key"),
                            F.lit(None).cast("string").alias("before_value"),
                            F.lit(None).cast("string").alias("after_value")))
             .when(first["status"] == "missing",
                   F.struct(F.lit(True).alias("same"), F.lit("error").alias("key"),
                            F.lit(None).cast("string").alias("before_value"),
                            F.lit(None).cast("string").alias("after_value")))
             .otherwise(F.struct(F.lit(False).alias("same"), first["key"].alias("key"),
                                 first["b"].alias("before_value"), first["a"].alias("after_value"))))


def context_redundancy(full: DataFrame, variants: DataFrame, key: str,
                       before: str = "before", after: str = "after",
                       variant_after: str = "after") -> DataFrame:
    """If the full command left the context unchanged every argument is
    redundant (score 0); otherwise a variant is redundant iff its whole
    comparison against the same baseline equals the full command's.  With
    a shared baseline, equal (same, key, after-text) <=> equal diff text,
    so no diff is computed here."""
    f = full.select(key, F.col(before).alias("_b"),
                    context_compare(F.col(before), F.col(after)).alias("_full"))
    v = variants.select(key, F.col(variant_after).alias("_va"))
    j = f.join(v, on=key, how="left")
    cmp_v = context_compare(F.col("_b"), F.col("_va"))
    red = ((cmp_v["same"] == F.col("_full.same")) & (cmp_v["key"] == F.col("_full.key"))
           & F.coalesce(cmp_v["after_value"] == F.col("_full.after_value"),
                        cmp_v["after_value"].isNull() & F.col("_full.after_value").isNull()))
    agg = j.groupBy(key).agg(
        F.first(F.col("_full.same")).alias("context_same"),
        F.first(F.col("_full.key")).alias("context_key"),
        F.count("_va").alias("n_args"),
        F.sum(F.when(F.col("_va").isNotNull() & red, 1).otherwise(0)).alias("n_variant_redundant"))
    n_red = F.when(F.col("context_same"), F.col("n_args")).otherwise(F.col("n_variant_redundant"))
    score = F.when(F.col("n_args") == 0, F.lit(0.5)).otherwise(1.0 - n_red / F.col("n_args"))
    return agg.withColumn("n_redundant", n_red).withColumn("context_redundancy_score", score) \
              .drop("n_variant_redundant")


def context_line_delta(df: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """Lines removed (-) and added (+) between two snapshots, with
    multiplicity (bag difference both ways), as rows."""
    from tracefold.functions.text import splitlines
    # outer generators + explicit filter: no inferred size() predicate that
    # would split the text a second time below the join
    b = df.select(*keys, F.explode_outer(splitlines(before)).alias("line")).where(F.col("line").isNotNull()) \
          .withColumn("side", F.lit(-1))
    a = df.select(*keys, F.explode_outer(splitlines(after)).alias("line")).where(F.col("line").isNotNull()) \
          .withColumn("side", F.lit(1))
    c = b.unionByName(a).groupBy(*keys, "line").agg(
        F.sum(F.when(F.col("side") < 0, 1).otherwise(0)).alias("nb"),
        F.sum(F.when(F.col("side") > 0, 1).otherwise(0)).alias("na"))
    return c.where(F.col("nb") != F.col("na")).select(
        *keys, "line",
        F.when(F.col("nb") > F.col("na"), F.lit("-")).otherwise(F.lit("+")).alias("change"),
        F.abs(F.col("nb") - F.col("na")).cast("bigint").alias("n"))
