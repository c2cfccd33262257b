"""Bulk command synthesis: seeded leftmost derivations over a grammar.

Rows are derivations, each carrying a symbol stack (leftmost first) and
its emitted text.  Every round, each unfinished row emits its leading
terminal pieces and resolves its first placeholder:
* a grammar key is expanded by one production chosen by a seeded hash
  (uniform over its productions, plus the terminal action when the
  nonterminal repeats);
  the choice is an equi-join on (nonterminal, index), so a derivation
  touches exactly one production row;
* file, directory, user, group and interface kinds are left in the text and
  filled at the end from an inventory by ``placeholder_candidates`` (one
  request per occurrence), when one is given;
* any other placeholder is a random terminal (numbers in range, fixed
  word lists, else a random alphanumeric string).
A repeating nonterminal stays on the stack until its terminal action, the
optional early stop or the argument limit.  Every expansion is bracketed by
marks; the command word is an argument of its own, and an argument ends
where a mark closes at depth 2 or less.  Rounds stop when no row is
unfinished; lineage is cut every few rounds, and finished rows are then
appended to a scratch table once.  A grammar whose derivations never end is
an error of the grammar: a nonterminal that leads back to itself must have a
production without it.  The uniform choice is the reference's random policy;
a learned policy's weights are not part of this library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.functions.text import PLACEHOLDER, split_placeholders
from tracefold.operators.grammar import GLOBAL_RANDOM, LOCAL_RANDOM, NUMBER_RANGES
from tracefold.operators.inventory import ALNUM, RANDOM_STRINGS, placeholder_candidates
from tracefold.session import cut_lineage, scratch_path

ARG_START, ARG_END = "\x01", "\x02"


def _h(*cols):
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("long")


def _fill(ph, h):
    """Value of a random terminal placeholder from the hash ``h``."""
    out = None
    for name, (lo, hi) in NUMBER_RANGES.items():
        v = (F.lit(lo) + h % F.lit(hi - lo + 1)).cast("string")
        out = F.when(ph == name, v) if out is None else out.when(ph == name, v)
    for name, vals in RANDOM_STRINGS.items():
        arr = F.array(*[F.lit(v) for v in vals])
        out = out.when(ph == name, F.element_at(arr, (h % len(vals) + 1).cast("int")))
    out = out.when(ph == "[Character]", F.lit(ALNUM).substr((h % len(ALNUM) + 1).cast("int"), F.lit(1)))
    return out.otherwise(F.md5(h.cast("string")).substr(F.lit(1), (h % 8 + 1).cast("int")))


def _arguments(pieces):
    """Pieces and marks -> arguments."""
    init = F.struct(F.array().cast("array<string>").alias("args"), F.lit("").alias("buf"), F.lit(0).alias("depth"))

    def step(acc, p):
        close = (p == ARG_END) & (acc["depth"] <= 3) & (acc["buf"] != "")
        word = (F.size(acc["args"]) == 0) & (F.trim(p) != "")  # the command word
        text = ~p.isin(ARG_START, ARG_END)
        args = F.when(close, F.concat(acc["args"], F.array(F.trim(acc["buf"])))).when(text & word, F.array(F.trim(p))).otherwise(acc["args"])
        buf = F.when(close | (text & word), F.lit("")).when(text & ~((acc["buf"] == "") & (p == " ")), F.concat(acc["buf"], p)).otherwise(acc["buf"])
        depth = acc["depth"] + F.when(p == ARG_START, 1).when(p == ARG_END, -1).otherwise(0)
        return F.struct(args.alias("args"), buf.alias("buf"), depth.alias("depth"))

    last = F.aggregate(pieces, init, step)
    return F.filter(F.when(last["buf"] == "", last["args"]).otherwise(F.concat(last["args"], F.array(F.trim(last["buf"])))), lambda a: a != "")


def _filled(rows: DataFrame, requests: DataFrame, inventory: DataFrame, seed: int) -> DataFrame:
    """Replace the inventory kinds among the pieces of each row; a row's
    pieces (bounded by the argument limit) are gathered again by id."""
    p = rows.select("id", "n_args", "rounds", F.posexplode("out").alias("pos", "piece"))
    p = cut_lineage(p.withColumn("req", F.concat_ws(":", F.col("id").cast("string"), F.col("pos").cast("string"))))
    asked = p.where(F.col("piece").isin(*LOCAL_RANDOM, *GLOBAL_RANDOM)).join(requests.select("id", "image", "cwd"), "id")
    got = placeholder_candidates(asked.select("req", "image", "cwd", F.col("piece").alias("placeholder")), inventory, seed)
    p = p.join(got.select("req", "value"), "req", "left").withColumn("piece", F.coalesce("value", "piece"))
    all_ = p.groupBy("id", "n_args", "rounds").agg(F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("_p"))
    return all_.select("id", F.transform("_p", lambda x: x["piece"]).alias("out"), "n_args", "rounds")


def derive_commands(grammar: DataFrame, requests: DataFrame, repeats: DataFrame, start: str = "[Input]",
                    max_args: int = 10, cut_every: int = 4, inventory: DataFrame | None = None,
                    early_stop: int | None = None, fill_seed: int = 0) -> DataFrame:
    """requests (id, seed[, image, cwd]) -> (id, command, args, n_args, rounds).
    ``early_stop`` n: a repeat ends with chance 1 in n at each turn.
    A repeating nonterminal that reached ``max_args`` takes its terminal
    action (the reference's position truncation)."""
    nts = grammar.groupBy("nonterminal").agg(F.count("*").alias("n_prod"))
    rep = repeats.select("nonterminal", F.lit(True).alias("is_rep")).distinct()
    info = nts.join(rep, "nonterminal", "left").withColumn("is_rep", F.coalesce("is_rep", F.lit(False)))
    info = cut_lineage(info.withColumnRenamed("nonterminal", "_head"))
    prods = grammar.select(F.col("nonterminal").alias("_head"), F.col("ordinal").alias("_idx"), F.col("production").alias("_production"))
    state = requests.select("id", "seed", F.array(F.lit(start)).alias("stack"),
                            F.array().cast("array<string>").alias("out"), F.lit(0).alias("n_args"),
                            F.lit(0).alias("rounds"))
    finished = None
    kept = [k for k in (*LOCAL_RANDOM, *GLOBAL_RANDOM)] if inventory is not None else [""]
    path, rnd = scratch_path(grammar.sparkSession, "derived"), 0
    while True:
        rnd += 1
        is_ph = F.transform("stack", lambda x: x.rlike(f"^{PLACEHOLDER}$"))
        first = F.array_position(is_ph, True).cast("int")
        s = state.withColumn("_f", first)
        # emit the leading terminal pieces
        s = s.withColumn("out", F.when(F.col("_f") == 0, F.concat("out", "stack"))
                         .otherwise(F.concat("out", F.slice("stack", 1, F.col("_f") - 1))))
        s = s.withColumn("stack", F.when(F.col("_f") == 0, F.array().cast("array<string>"))
                         .otherwise(F.slice("stack", F.col("_f"), F.size("stack"))))
        done = s.where(F.size("stack") == 0)
        live = s.where(F.size("stack") > 0).withColumn("_head", F.element_at("stack", 1)) \
                .withColumn("_rest", F.slice("stack", 2, F.size("stack")))
        live = live.join(info, "_head", "left")
        h = _h(F.col("seed").cast("string"), F.col("id").cast("string"), F.lit(str(rnd)))
        live = live.withColumn("_hash", h)
        at_limit = F.col("is_rep") & (F.col("n_args") >= max_args)
        if early_stop:
            chance = _h(F.lit("stop"), F.col("seed").cast("string"), F.col("id").cast("string"), F.lit(str(rnd)))
            at_limit = at_limit | (F.col("is_rep") & (chance % early_stop == 0))
        n_choice = F.col("n_prod") + F.when(F.col("is_rep"), 1).otherwise(0)
        idx = F.when(at_limit, F.col("n_prod")).otherwise(F.col("_hash") % n_choice)
        live = live.withColumn("_idx", F.when(F.col("n_prod").isNotNull(), idx.cast("int")))
        # only the chosen productions are cut up
        live = live.join(prods, ["_head", "_idx"], "left").withColumn("_pieces", split_placeholders("_production"))
        key = F.col("n_prod").isNotNull()
        terminal_action = key & F.col("_pieces").isNull()            # idx == n_prod: stop repeating
        expand_rep = key & F.col("is_rep") & F.col("_pieces").isNotNull()
        inside = F.concat(F.array(F.lit(ARG_START)), F.col("_pieces"), F.array(F.lit(ARG_END)))
        new_stack = (F.when(~key, F.col("_rest"))
                      .when(terminal_action, F.col("_rest"))
                      .when(expand_rep, F.concat(inside, F.array(F.col("_head")), F.col("_rest")))
                      .otherwise(F.concat(inside, F.col("_rest"))))
        value = F.when(F.col("_head").isin(*kept), F.col("_head")).otherwise(_fill(F.col("_head"), F.col("_hash")))
        new_out = F.when(~key, F.concat("out", F.array(F.lit(ARG_START), value, F.lit(ARG_END)))).otherwise(F.col("out"))
        live = live.select("id", "seed", new_stack.alias("stack"), new_out.alias("out"),
                           (F.col("n_args") + F.when(expand_rep, 1).otherwise(0)).alias("n_args"),
                           F.lit(rnd).alias("rounds"))
        done = done.select("id", "seed", "stack", "out", "n_args", "rounds")
        finished = done if finished is None else finished.unionByName(done)
        if rnd % cut_every == 0:
            finished.select("id", "out", "n_args", "rounds").write.mode("append").parquet(path)
            finished = None
            live = cut_lineage(live)
            if live.isEmpty():
                break
        state = live
    done = grammar.sparkSession.read.parquet(path)
    if inventory is not None:
        done = _filled(done, requests, inventory, fill_seed)
    done = done.withColumn("args", _arguments(F.col("out")))
    cmd = F.trim(F.regexp_replace(F.array_join("args", " "), r"\s+", " "))
    return done.select("id", cmd.alias("command"), "args", "n_args", "rounds")
