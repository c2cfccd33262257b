"""Placeholder inventory: directory listings, wildcard expansion, archive
signatures, account / interface names and placeholder filling.

A listing is a table (image, path, kind 'f'|'d', is_exec).  Prefix
relations (a directory under a wildcard base, an entry under its cwd)
are turned into equi-joins on generated ancestors, never theta joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from tracefold.operators.actions import words
from tracefold.operators.numbering import global_rank
from tracefold.operators.grammar import LOCAL_RANDOM, NUMBER_RANGES

# String-valued random terminals.
RANDOM_STRINGS = {
    "[Password]": ["password", "pass", "1234", "admin"],
    "[Word]": ["matrix", "region", "rusted", "monkey", "browse", "uproot", "outlet", "accept", "immune",
               "forked", "banana", "bob", "bumblebee", "ubuntu"],
    "[String]": ["matrix", "region", "rusted", "monkey", "browse", "uproot", "outlet", "accept", "immune",
                 "forked", "banana", "bob", "bumblebee", "ubuntu"],
    "[NewFile]": ["file", "file.1", "file.2", "file.txt", "newfile", "newfile1"],
    "[NewDirectory]": ["dir", "dir1", "docs", "newdir", "newdir1"],
    "[NewExecutable]": ["exec", "newexec", "exec.sh", "esec.py"],
    "[UtilPath]": ["/usr/bin/ls", "/usr/bin/sh", "/usr/bin/pwd", "/usr/bin/w", "/usr/bin/ls", "/usr/bin/ps",
                   "/var/log/auth.log", "/var/log/syslog"],
}
ALNUM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

# Archive magic numbers (hex) and the tar marker at byte 257.
ZIP_MAGIC = ["504B0304", "1F8B", "377ABCAF271C"]
TAR_MARKER_HEX = "7573746172"  # "ustar"


def _parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def parent_dir(path: Column) -> Column:
    p = F.regexp_replace(path, r"/[^/]*$", "")
    return F.when(p == "", F.lit("/")).otherwise(p)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def ancestors(path: Column, max_up: int | None = None) -> Column:
    """array<struct<up:int, dir:string>>: the path itself (up 0) and its
    ancestors up to ``max_up`` levels (all when None), '/' included."""
    parts = _parts(path)
    n = F.size(parts)
    top = n if max_up is None else F.least(n, F.lit(max_up))
    return F.transform(F.sequence(F.lit(0), top), lambda k: F.struct(
        k.alias("up"),
        F.when(n - k == 0, F.lit("/")).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n - k), "/")))
        .alias("dir")))


def listing_from_paths(files: DataFrame) -> DataFrame:
    """Files (image, path, is_exec) plus every ancestor directory."""
    f = files.select("image", "path", F.lit("f").alias("kind"), "is_exec")
    anc = files.select("image", F.explode(ancestors(F.col("path"))).alias("a")) \
               .where(F.col("a.up") > 0).select("image", F.col("a.dir").alias("path")).distinct()
    d = anc.select("image", "path", F.lit("d").alias("kind"), F.lit(False).alias("is_exec"))
    return f.unionByName(d)


def path_inventory(listing: DataFrame) -> DataFrame:
    """(image, cwd, placeholder, value): per directory its files, '.', sub-
    directories and '..', executables; global forms cwd + '/' + name
    (also for '/', as the reference builds them) with cwd null; [Path] is
    the bag of all three global lists."""
    dirs = listing.where(F.col("kind") == "d").select("image", F.col("path").alias("cwd"))
    ent = listing.where(F.col("path") != "/").select(
        "image", parent_dir(F.col("path")).alias("cwd"), base_name(F.col("path")).alias("name"), "kind", "is_exec")
    files = ent.where(F.col("kind") == "f")
    local = [
        files.select("image", "cwd", F.lit("[File]").alias("placeholder"), F.col("name").alias("value")),
        files.where("is_exec").select("image", "cwd", F.lit("[Executable]").alias("placeholder"),
                                      F.col("name").alias("value")),
        dirs.select("image", "cwd", F.lit("[Directory]").alias("placeholder"), F.lit(".").alias("value")),
        ent.where(F.col("kind") == "d").select("image", "cwd", F.lit("[Directory]").alias("placeholder"),
                                               F.col("name").alias("value")),
        dirs.select("image", "cwd", F.lit("[Directory]").alias("placeholder"), F.lit("..").alias("value")),
    ]
    loc = local[0]
    for x in local[1:]:
        loc = loc.unionByName(x)
    glob_name = {"[File]": "[GlobalFile]", "[Directory]": "[GlobalDirectory]", "[Executable]": "[GlobalExecutable]"}
    g = loc.select("image", F.lit(None).cast("string").alias("cwd"),
                   F.element_at(F.create_map(*[F.lit(x) for kv in glob_name.items() for x in kv]),
                                F.col("placeholder")).alias("placeholder"),
                   F.concat(F.col("cwd"), F.lit("/"), F.col("value")).alias("value"))
    path = g.select("image", "cwd", F.lit("[Path]").alias("placeholder"), "value")
    return loc.unionByName(g).unionByName(path)


def path_union(inventory: DataFrame) -> DataFrame:
    return inventory.where(F.col("placeholder") == "[Path]").select("image", "value")


def expand_dirs(listing: DataFrame, specs: DataFrame, depth: int = 3, ignore_hidden: bool = True) -> DataFrame:
    """Spec ending in '*': every directory at depth 0..depth below the base
    (paths with a '/.' component excluded when ignore_hidden); other
    specs are kept when the directory exists.  Equi-join of each
    directory's ancestors (<= depth levels up) to the wildcard bases."""
    dirs = listing.where(F.col("kind") == "d").select("image", F.col("path").alias("dir")).distinct()
    star = specs.where(F.col("spec").endswith("*")).withColumn(
        "base", F.regexp_replace(F.regexp_replace("spec", r"\*+$", ""), r"(?<=.)/+$", ""))
    star = star.withColumn("base", F.when(F.col("base") == "", F.lit("/")).otherwise(F.col("base")))
    anc = dirs.select("image", "dir", F.explode(ancestors(F.col("dir"), depth)).alias("a")) \
              .select("image", "dir", F.col("a.dir").alias("base"))
    hit = star.join(anc, ["image", "base"]).select("image", "spec", "dir")
    if ignore_hidden:
        hit = hit.where(~F.col("dir").contains("/."))
    plain = specs.where(~F.col("spec").endswith("*")).join(
        dirs.withColumnRenamed("dir", "spec"), ["image", "spec"], "left_semi").select("image", "spec", F.col("spec").alias("dir"))
    return hit.unionByName(plain)


def file_signature(content: Column) -> Column:
    """[ZipFile] for zip / gzip / 7z magic, [TarFile] for 'ustar' at byte
    257, else null."""
    h = lambda n: F.hex(F.substring(content, 1, n))
    is_zip = (h(4) == ZIP_MAGIC[0]) | (h(2) == ZIP_MAGIC[1]) | (h(6) == ZIP_MAGIC[2])
    is_tar = F.hex(F.substring(content, 258, 5)) == TAR_MARKER_HEX
    return F.when(is_zip, F.lit("[ZipFile]")).when(is_tar, F.lit("[TarFile]"))


def file_minus_archives(files: DataFrame, archives: DataFrame, keys: list[str]) -> DataFrame:
    return files.join(archives.select(*keys).distinct(), keys, "left_anti")


def account_names(df: DataFrame, text: str) -> DataFrame:
    """First ':' field of every line, split on whitespace (as the shell
    pipeline's word splitting does): candidate user / group names."""
    from tracefold.functions.text import splitlines
    lines = df.select(F.explode_outer(splitlines(text)).alias("line")).where(F.col("line").isNotNull())
    first = F.split(F.col("line"), ":").getItem(0)
    return lines.select(F.explode_outer(words(first)).alias("name")).where(F.col("name").isNotNull())


def interface_names(df: DataFrame, line: str) -> DataFrame:
    """Lines ``^[0-9]+:`` of ``ip link`` output -> their second ':' field,
    trimmed and word-split."""
    ok = df.where(F.col(line).rlike(r"^[0-9]+:"))
    second = F.split(F.col(line), ":").getItem(1)
    return ok.select(F.explode_outer(words(second)).alias("name")).where(F.col("name").isNotNull())


def _hash_int(*cols: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("long")


def placeholder_candidates(requests: DataFrame, inventory: DataFrame, seed: int = 0) -> DataFrame:
    """Fill each request (req, image, cwd, placeholder) with one value,
    uniformly by a seeded hash: local kinds from (image, cwd), global kinds
    from (image), string kinds from their fixed lists, number kinds from
    their inclusive ranges, [Character] one alphanumeric, anything else
    (or an empty list) a random alphanumeric string of length 1..8.

    The pick is exact and join-bounded: candidates are numbered per key
    and a request joins only the candidate at index hash(req) mod count."""
    spark = requests.sparkSession
    local = set(LOCAL_RANDOM)
    strings = spark.createDataFrame([(k, v) for k, vs in RANDOM_STRINGS.items() for v in vs],
                                    "placeholder string, value string")
    inv = inventory.select("image", F.coalesce("cwd", F.lit("")).alias("cwd"), "placeholder", "value")
    cand = inv.unionByName(strings.select(F.lit("").alias("image"), F.lit("").alias("cwd"), "placeholder", "value"))
    ranked = global_rank(cand, ["value"], out="_i", group=["image", "cwd", "placeholder"], narrow=False)  # a bag
    counts = cand.groupBy("image", "cwd", "placeholder").agg(F.count("*").alias("_n"))
    ph = F.col("placeholder")
    key_img = F.when(ph.isin(*RANDOM_STRINGS), F.lit("")).otherwise(F.col("image"))
    key_cwd = F.when(ph.isin(*local), F.coalesce(F.col("cwd"), F.lit(""))).otherwise(F.lit(""))
    r = requests.withColumn("_img", key_img).withColumn("_cwd", key_cwd) \
                .withColumn("_h", _hash_int(F.lit(str(seed)), F.col("req").cast("string")))
    r = r.join(counts.withColumnRenamed("image", "_img").withColumnRenamed("cwd", "_cwd"),
               ["_img", "_cwd", "placeholder"], "left")
    r = r.withColumn("_i", F.when(F.col("_n") > 0, F.col("_h") % F.col("_n") + 1))
    picked = r.join(ranked.withColumnRenamed("image", "_img").withColumnRenamed("cwd", "_cwd")
                    .select("_img", "_cwd", "placeholder", "_i", F.col("value").alias("_v")),
                    ["_img", "_cwd", "placeholder", "_i"], "left")
    num = None
    for name, (lo, hi) in NUMBER_RANGES.items():
        v = (F.lit(lo) + F.col("_h") % F.lit(hi - lo + 1)).cast("string")
        num = F.when(ph == name, v) if num is None else num.when(ph == name, v)
    char = F.lit(ALNUM).substr((F.col("_h") % len(ALNUM) + 1).cast("int"), F.lit(1))
    rnd = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("s"), F.col("req").cast("string"))) \
           .substr(F.lit(1), (F.col("_h") % 8 + 1).cast("int"))
    value = (F.when(ph.isin(*NUMBER_RANGES), num)
              .when(ph == "[Character]", char)
              .when(F.col("_v").isNotNull(), F.col("_v"))
              .otherwise(rnd))
    return picked.select("req", "placeholder", value.alias("value"))
