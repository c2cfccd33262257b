"""Path resolution as native array folds (no UDF).

A ``cd`` spec is also a *function* on the working directory:
struct(abs, pops, parts) = "reset (abs) or pop ``pops`` levels, then
append ``parts``".  Such functions compose associatively, which lets a
session's directory be tracked by a blocked scan instead of one ordered
pass over the whole session (see operators.sessions.cwd_track).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STR_ARR = "array<string>"
FN_TYPE = "struct<abs:boolean,pops:int,parts:array<string>>"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _expand_home(spec: Column) -> Column:
    return F.when(spec.startswith("~/"), F.concat(F.lit("/root/"), spec.substr(F.lit(3), F.length(spec)))) \
            .otherwise(spec)


def _pieces(path: Column) -> Column:
    return F.split(F.regexp_replace(path, "/+$", ""), "/")


def _render(parts: Column) -> Column:
    return (F.when(F.size(parts) == 0, F.lit("/"))
             .when(F.element_at(parts, 1) == "~", F.array_join(parts, "/"))
             .otherwise(F.concat(F.lit("/"), F.array_join(parts, "/"))))


def _pop(parts: Column, n) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    keep = F.greatest(F.size(parts) - n, F.lit(0))
    return F.slice(parts, 1, keep)


def resolve_path(spec, cwd) -> Column:
    """``~/x`` -> /root/x; a leading / or ~ restarts; '.' and '' skipped;
    '..' pops (no-op at root); '~' -> ~; empty result -> '/'.  An empty
    spec (an error in the reference) returns cwd."""
    spec, cwd = _c(spec), _c(cwd)
    path = _expand_home(spec)
    first = F.substring(path, 1, 1)
    start = F.when(first.isin("/", "~"), F.array().cast(STR_ARR)) \
             .otherwise(F.filter(F.split(cwd, "/"), lambda x: x != ""))
    folded = F.aggregate(
        _pieces(path), start,
        lambda acc, p: (F.when(p == "..", _pop(acc, 1))
                         .when(p.isin(".", ""), acc)
                         .when(p == "~", F.array(F.lit("~")))
                         .otherwise(F.concat(acc, F.array(p)))))
    return F.when(F.coalesce(spec, F.lit("")) == "", cwd).otherwise(_render(folded))


def identity_fn() -> Column:
    return F.struct(F.lit(False).alias("abs"), F.lit(0).alias("pops"), F.array().cast(STR_ARR).alias("parts"))


def cd_function(cmd) -> Column:
    """The directory function of one command: identity unless its first
    space token is ``cd``; the spec is the last space token (so a bare
    ``cd`` resolves the word cd, as the reference does)."""
    toks = F.split(_c(cmd), " ")
    spec = F.element_at(toks, -1)
    path = _expand_home(spec)
    is_abs = F.substring(path, 1, 1).isin("/", "~")
    init = F.struct(is_abs.alias("abs"), F.lit(0).alias("pops"), F.array().cast(STR_ARR).alias("parts"))

    def step(acc, p):
        popped = F.struct(acc["abs"].alias("abs"),
                          F.when((F.size(acc["parts"]) == 0) & ~acc["abs"], acc["pops"] + 1)
                           .otherwise(acc["pops"]).alias("pops"),
                          _pop(acc["parts"], 1).alias("parts"))
        home = F.struct(F.lit(True).alias("abs"), F.lit(0).alias("pops"),
                        F.array(F.lit("~")).alias("parts"))
        app = F.struct(acc["abs"].alias("abs"), acc["pops"].alias("pops"),
                       F.concat(acc["parts"], F.array(p)).alias("parts"))
        return F.when(p == "..", popped).when(p.isin(".", ""), acc).when(p == "~", home).otherwise(app)

    fn = F.aggregate(_pieces(path), init, step)
    is_cd = (F.element_at(toks, 1) == "cd") & (F.coalesce(spec, F.lit("")) != "")
    return F.when(is_cd, fn).otherwise(identity_fn())


def compose(f: Column, g: Column) -> Column:
    """f then g."""
    short = g["pops"] <= F.size(f["parts"])
    rel = F.struct(
        f["abs"].alias("abs"),
        F.when(f["abs"], F.lit(0)).when(short, f["pops"])
         .otherwise(f["pops"] + g["pops"] - F.size(f["parts"])).alias("pops"),
        F.when(short | f["abs"], F.concat(_pop(f["parts"], g["pops"]), g["parts"]))
         .otherwise(g["parts"]).alias("parts"))
    return F.when(g["abs"], g).otherwise(rel)


def apply_fn(f: Column, cwd) -> Column:
    cwd = _c(cwd)
    base = F.filter(F.split(cwd, "/"), lambda x: x != "")
    parts = F.when(f["abs"], f["parts"]).otherwise(F.concat(_pop(base, f["pops"]), f["parts"]))
    return _render(parts)
