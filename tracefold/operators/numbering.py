"""Global numbering and prefix sums without a single-partition window.

Rows are range-partitioned on the order key (a hot group is split over
many partitions), each partition is counted/summed, the per-partition
totals (one row per partition: bounded) are turned into offsets and
broadcast back.  Exchange reuse means the range shuffle runs once.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold.operators.nullsafe import join_same


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _tagged(df: DataFrame, order: list, n: int | None = None) -> DataFrame:
    """Range-partitioned, sorted rows tagged with partition id and position."""
    n = n or _parts(df)
    s = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return s.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())


def _sorted(df: DataFrame, order: list, n: int | None = None) -> DataFrame:
    """Tagged rows, materialised once: the tags are nondeterministic
    expressions, and the counting pass and the numbering pass must see the
    same ones.  A reliable checkpoint in the shared folder (survives executor
    loss) keeps partitions and their order, which scans need."""
    from tracefold.session import cut_lineage
    return cut_lineage(_tagged(df, order, n))


def _rank_rows(df: DataFrame, keys: list, out: str, group: list) -> DataFrame:
    from tracefold.session import stored
    s = stored(_tagged(df, keys), "ranked")  # the tags say all: a columnar table, of which the count reads one column
    counts = s.groupBy("_pid").agg(F.count("*").alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offs = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    r = s.join(F.broadcast(offs), "_pid").withColumn(out, F.col("_off") + local + 1)
    if group:
        starts = r.groupBy(*group).agg(F.min(out).alias("_start"))
        r = join_same(r, starts, group).withColumn(out, F.col(out) - F.col("_start") + 1).drop("_start")
    return r.drop("_pid", "_mid", "_off")


def global_rank(df: DataFrame, order: list, out: str = "rn", group: list | None = None,
                narrow: bool = True) -> DataFrame:
    """1-based row number in ``order`` (column names; make them unique with
    a tie-break); with ``group``, numbering restarts per group (group cols
    lead the range key so a group's rows are contiguous).

    ``narrow`` (default): only the key columns are ranked (and
    checkpointed); the numbers are joined back on the keys, so wide rows
    (whole texts) are never rewritten and column pruning still reaches the
    scan.  Keys must then be unique (rows sharing all keys share a number);
    pass ``narrow=False`` to number duplicate rows individually."""
    group = list(group or [])
    keys = group + list(order)
    if not narrow:
        return _rank_rows(df, [F.col(k) for k in keys], out, group)
    ranked = _rank_rows(df.select(*keys).distinct(), [F.col(k) for k in keys], out, group)
    return join_same(df, ranked, keys)


def prefix_sum(df: DataFrame, order: list, value: str, out: str = "prefix",
               inclusive: bool = False) -> DataFrame:
    """Running sum of ``value`` over the whole table in ``order``; the
    exclusive form is the sum of all rows strictly before.

    The in-partition running sum is a per-partition scan (mapInPandas on
    the range-sorted partitions: no second shuffle); partition totals
    become broadcast offsets."""
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    s = _sorted(df, keys)
    sums = s.groupBy("_pid").agg(F.sum(value).alias("_s"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = sums.select("_pid", F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_off"))
    vtype = s.schema[value].dataType

    def scan(batches):
        run = 0
        for pdf in batches:
            cs = pdf[value].fillna(0).cumsum() + run
            if len(cs):
                run = cs.iloc[-1]
            yield pdf.assign(_run=cs)

    schema = T.StructType(list(s.schema.fields) + [T.StructField("_run", vtype)])  # no in-place add
    r = s.mapInPandas(scan, schema).join(F.broadcast(offs), "_pid")
    val = F.col("_off") + F.col("_run")
    if not inclusive:
        val = val - F.coalesce(F.col(value), F.lit(0))
    return r.withColumn(out, val).drop("_pid", "_mid", "_off", "_run")


def block_size(gamma: float, cap: int = 65536) -> int:
    """Largest block whose weights gamma^e (e < block) stay >= 1e-100."""
    if gamma >= 1.0:
        return cap
    if gamma <= 0.0:
        return 1
    return max(1, min(cap, int(100.0 / -math.log10(gamma))))


def reverse_discounted_sum(df: DataFrame, group: list, t: str, value: str, gamma: float,
                           out: str = "G", block: int | None = None) -> DataFrame:
    """out_t = sum_{k >= t} gamma^(k-t) * value_k within each group, for a
    dense step index ``t`` (0..n-1).

    Steps are cut into blocks of B: inside a block a window frame (at most
    B rows) gives the rebased suffix sum; the block totals S_b obey the
    same recurrence with factor gamma^B, so the operator is applied to the
    block table itself (B times smaller) to get each block's carry
    gamma^B * G'_{b+1}.  No group is held by one task, no array grows with
    the group, and weights never under/overflow however long it is."""
    B = min(block, block_size(gamma)) if block else block_size(gamma)  # never beyond the safe size
    g = F.lit(float(gamma))
    d = (df.withColumn("_blk", F.floor(F.col(t) / B).cast("long"))
           .withColumn("_e", (F.col(t) - F.col("_blk") * B).cast("double"))
           .withColumn("_w", F.pow(g, F.col("_e")) * F.col(value)))
    wb = Window.partitionBy(*group, "_blk").orderBy(F.col(t).desc()) \
               .rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_suffix", F.sum("_w").over(wb))
    gB = float(gamma) ** B
    max_blk = d.agg(F.max("_blk")).first()[0] or 0  # one scalar: do later blocks exist at all?
    if max_blk > 0 and gB > 0.0:
        tot = d.groupBy(*group, F.col("_blk").alias("_tb")).agg(F.sum("_w").alias("_S"))
        lvl = reverse_discounted_sum(tot, group, "_tb", "_S", gB, out="_G2", block=block)
        carry = lvl.select(*group, (F.col("_tb") - 1).alias("_blk"), (F.lit(gB) * F.col("_G2")).alias("_carry"))
        d = join_same(d, carry, group + ["_blk"], "left")
    else:
        d = d.withColumn("_carry", F.lit(0.0))
    return (d.withColumn(out, F.pow(g, -F.col("_e")) * (F.col("_suffix") + F.coalesce("_carry", F.lit(0.0))))
             .drop("_blk", "_e", "_w", "_suffix", "_carry"))


def grouped_scan(df: DataFrame, group: list, order: list, value: str, op: str = "sum",
                 out: str = "scan") -> DataFrame:
    """Inclusive running ``op`` ('sum', or 'max' ignoring nulls and carrying
    the last maximum forward) of ``value`` within each group, in ``order``
    (column names, unique within a group).

    No per-group window: rows are range-partitioned on (group, order), so
    a hot group spans many partitions; each partition is scanned in Arrow
    batches (mapInPandas, no further shuffle); a group that continues from
    earlier partitions gets the carry of those partitions, computed from
    one summary row per partition (a bounded table)."""
    import numpy as np
    import pandas as pd

    wide = df
    df = df.select(*group, *order, value)  # scan only the keys and the value; join back at the end
    keys = [F.col(c) for c in group] + [F.col(o) for o in order]
    s = _sorted(df, keys)
    vtype = s.schema[value].dataType
    whole = isinstance(vtype, T.IntegralType)  # long sums and maxima stay exact
    run_type = T.LongType() if whole else T.DoubleType()
    lowest = np.iinfo("int64").min if whole else -np.inf  # stands for "no value yet" in a maximum

    def combine(a, b):
        return np.maximum(a, b) if op == "max" else a + b

    def scan(batches):
        cur, carry = None, None
        for pdf in batches:
            v = pdf[value]
            if whole:
                v = v.astype("Int64").fillna(lowest if op == "max" else 0).astype("int64")
            else:
                v = v.astype("float64").fillna(lowest if op == "max" else 0.0)
            if pdf.empty:
                yield pdf.assign(_run=v)
                continue
            # rows come sorted by key: a group begins where a key column changes (null is a value of its own)
            begins = np.zeros(len(pdf), bool)
            for c in group:
                here, before = pdf[c].iloc[1:].reset_index(drop=True), pdf[c].iloc[:-1].reset_index(drop=True)
                same = (here == before).fillna(False).astype(bool) | (here.isna() & before.isna())
                begins[1:] |= ~same.to_numpy()
            number = begins.cumsum()
            by = v.groupby(number, sort=False)
            run = by.cummax() if op == "max" else by.cumsum()
            first, last = (tuple(None if pd.isna(x) else x for x in pdf[group].iloc[k]) for k in (0, -1))
            if cur is not None and first == cur:
                run = run.where(number != 0, combine(run, carry))
            cur, carry = last, run.iloc[-1]
            yield pdf.assign(_run=run.values)

    schema = T.StructType(list(s.schema.fields) + [T.StructField("_run", run_type)])
    from tracefold.session import cut_lineage
    scanned = cut_lineage(s.mapInPandas(scan, schema))  # summary and fix-up read the same scan
    gstruct = F.struct(*[F.col(c) for c in group])
    summ = scanned.groupBy("_pid").agg(F.min_by(gstruct, "_mid").alias("gf"), F.max_by(gstruct, "_mid").alias("gl"),
                                       F.max_by("_run", "_mid").alias("vl"))
    rows = sorted(summ.collect(), key=lambda r: r["_pid"])  # one row per partition
    carries, acc_g, acc_v = [], None, None
    for r in rows:
        go_on = acc_v is not None and acc_g == r["gf"]
        carries.append((r["_pid"], acc_v if go_on else None))
        last = r["vl"]
        if go_on and r["gf"] == r["gl"]:  # the whole partition continues the chain
            last = max(acc_v, last) if op == "max" else acc_v + last
        acc_g, acc_v = r["gl"], last
    spark = df.sparkSession
    cdf = spark.createDataFrame(carries, T.StructType([T.StructField("_pid", T.IntegerType()), T.StructField("_carry", run_type)]))
    firsts = spark.createDataFrame([(r["_pid"], r["gf"]) for r in rows],
                                   T.StructType([T.StructField("_pid", T.IntegerType()),
                                                 T.StructField("_gf", summ.schema["gf"].dataType)]))
    j = scanned.join(F.broadcast(cdf), "_pid", "left").join(F.broadcast(firsts), "_pid", "left")
    goes_on = gstruct.eqNullSafe(F.col("_gf")) & F.col("_carry").isNotNull()
    joined = F.greatest("_run", "_carry") if op == "max" else F.col("_run") + F.col("_carry")
    fixed = F.when(goes_on, joined).otherwise(F.col("_run"))
    if op == "max":
        fixed = F.when(fixed != F.lit(lowest), fixed)
    res = j.withColumn(out, fixed.cast(vtype)).select(*group, *order, out)
    return join_same(wide, res, [*group, *order])
