"""Queries: placeholder inventory derived from the pages table (host =
image, URL path = file, its ancestors = directories, a fragment marks an
executable), archive signatures of page bodies, names from texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold.operators import inventory as I
from tracefold.plans import sqlfrag as Q
from tracefold.plans.registry import register
from tracefold.sources.tables import table

HOST = r"^https?://([^/]+)"
PATH = r"^https?://[^/]+(/[^?#]*)"


def _pages(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", "url", "html", F.regexp_extract("url", HOST, 1).alias("image"),
        F.regexp_extract("url", PATH, 1).alias("path"))


def _listing(spark, sf):
    p = _pages(spark, sf)
    f = p.where((F.col("path") != "") & ~F.col("path").endswith("/")) \
         .groupBy("image", "path").agg(F.max(F.col("url").contains("#")).alias("is_exec"))
    return I.listing_from_paths(f)


SQL_LISTING = {
    "pg": f"""SELECT page_id, url, html, regexp_extract(url, '{HOST}', 1) AS image,
              regexp_extract(url, '{PATH}', 1) AS path FROM pages""",
    "fl": """SELECT image, path, bool_or(contains(url, '#')) AS is_exec FROM pg
             WHERE path <> '' AND NOT ends_with(path, '/') GROUP BY image, path""",
    "anc": """SELECT DISTINCT image, CASE WHEN n - k = 0 THEN '/' ELSE '/' || array_to_string(parts[1:n - k], '/') END AS path
              FROM (SELECT image, parts, len(parts) AS n, unnest(range(1, len(parts) + 1)) AS k
                    FROM (SELECT image, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM fl))""",
    "listing": """SELECT image, path, 'f' AS kind, is_exec FROM fl UNION ALL SELECT image, path, 'd', false FROM anc""",
}
SQL_INV = dict(SQL_LISTING)
SQL_INV.update({
    "dirs": "SELECT image, path AS cwd FROM listing WHERE kind = 'd'",
    "ent": """SELECT image, CASE WHEN regexp_replace(path, '/[^/]*$', '') = '' THEN '/'
                               ELSE regexp_replace(path, '/[^/]*$', '') END AS cwd,
                     regexp_extract(path, '([^/]*)$', 1) AS name, kind, is_exec FROM listing WHERE path <> '/'""",
    "loc": """SELECT image, cwd, '[File]' AS placeholder, name AS value FROM ent WHERE kind = 'f'
              UNION ALL SELECT image, cwd, '[Executable]', name FROM ent WHERE kind = 'f' AND is_exec
              UNION ALL SELECT image, cwd, '[Directory]', '.' FROM dirs
              UNION ALL SELECT image, cwd, '[Directory]', name FROM ent WHERE kind = 'd'
              UNION ALL SELECT image, cwd, '[Directory]', '..' FROM dirs""",
    "gl": """SELECT image, CAST(NULL AS VARCHAR) AS cwd, CASE placeholder WHEN '[File]' THEN '[GlobalFile]'
                      WHEN '[Directory]' THEN '[GlobalDirectory]' ELSE '[GlobalExecutable]' END AS placeholder,
                      cwd || '/' || value AS value FROM loc""",
    "inv": """SELECT * FROM loc UNION ALL SELECT * FROM gl UNION ALL SELECT image, cwd, '[Path]', value FROM gl""",
})


def W(body, extra):
    from tracefold.plans.fixtures import with_views
    return with_views(body, extra=extra)


@register("path_inventory", W("SELECT image, cwd, placeholder, value FROM inv", SQL_INV))
def q_path_inventory(spark, sf):
    return I.path_inventory(_listing(spark, sf))


@register("path_union", W("SELECT image, value FROM inv WHERE placeholder = '[Path]'", SQL_INV))
def q_path_union(spark, sf):
    return I.path_union(I.path_inventory(_listing(spark, sf)))


def _specs(listing):
    tops = listing.where((F.col("kind") == "d") & (F.col("path") != "/")
                         & ~F.expr("substr(path, 2)").contains("/")).select("image", F.col("path").alias("t")).distinct()
    root = listing.select("image").distinct().select("image", F.lit("/*").alias("spec"))
    return root.unionByName(tops.select("image", F.concat("t", F.lit("/*")).alias("spec"))) \
               .unionByName(tops.select("image", F.col("t").alias("spec"))) \
               .unionByName(tops.select("image", F.concat("t", F.lit("/none")).alias("spec")))


_DEPTH = "len(list_filter(string_split({0}, '/'), lambda x: x <> ''))"
SQL_EXP = dict(SQL_LISTING)
SQL_EXP.update({
    "tops": """SELECT DISTINCT image, path AS t FROM listing WHERE kind = 'd' AND path <> '/' AND NOT contains(substr(path, 2), '/')""",
    "specs": """SELECT DISTINCT image, '/*' AS spec FROM listing UNION ALL SELECT image, t || '/*' FROM tops
                UNION ALL SELECT image, t FROM tops UNION ALL SELECT image, t || '/none' FROM tops""",
    "dd": "SELECT DISTINCT image, path AS dir FROM listing WHERE kind = 'd'",
    "st": """SELECT image, spec, CASE WHEN rtrim(spec, '*') = '/' THEN '/' ELSE rtrim(rtrim(spec, '*'), '/') END AS base
             FROM specs WHERE ends_with(spec, '*')""",
})


@register("expand_dirs", W(f"""
SELECT st.image, st.spec, dd.dir FROM st JOIN dd ON st.image = dd.image
WHERE (st.base = '/' OR dd.dir = st.base OR starts_with(dd.dir, st.base || '/'))
  AND {_DEPTH.format('dd.dir')} - {_DEPTH.format('st.base')} <= 3 AND NOT contains(dd.dir, '/.')
UNION ALL SELECT s.image, s.spec, s.spec FROM specs s WHERE NOT ends_with(s.spec, '*')
  AND s.spec IN (SELECT dir FROM dd WHERE dd.image = s.image)""", SQL_EXP))
def q_expand_dirs(spark, sf):
    lst = _listing(spark, sf)
    return I.expand_dirs(lst, _specs(lst), depth=3)


def _content(p):
    b = F.encode("html", "UTF-8")
    url = F.col("url")
    magic = (F.when(url.startswith("https://m."), F.unhex(F.lit("504B0304")))
              .when(url.contains(".org/"), F.unhex(F.lit("1F8B")))
              .when(url.contains(".net/") & url.contains("#"), F.unhex(F.lit("377ABCAF271C"))))
    tar = F.concat(F.substring(b, 1, 257), F.encode(F.lit("ustar"), "UTF-8"), F.substring(b, 258, 1 << 30))
    return F.when(magic.isNotNull(), F.concat(magic, b)).when(url.contains("?page="), tar).otherwise(b)


SQL_SIG = dict(SQL_LISTING)
SQL_SIG.update({
    "ch": """SELECT page_id, image, path, CASE
               WHEN starts_with(url, 'https://m.') THEN '504B0304' || hex(encode(html))
               WHEN contains(url, '.org/') THEN '1F8B' || hex(encode(html))
               WHEN contains(url, '.net/') AND contains(url, '#') THEN '377ABCAF271C' || hex(encode(html))
               WHEN contains(url, '?page=') THEN substr(hex(encode(html)), 1, 514) || '7573746172' || substr(hex(encode(html)), 515)
               ELSE hex(encode(html)) END AS hx FROM pg""",
    "sig": """SELECT page_id, image, path, CASE WHEN substr(hx, 1, 8) = '504B0304' OR substr(hx, 1, 4) = '1F8B'
                OR substr(hx, 1, 12) = '377ABCAF271C' THEN '[ZipFile]'
                WHEN substr(hx, 515, 10) = '7573746172' THEN '[TarFile]' END AS kind FROM ch""",
})


def _signatures(spark, sf):
    p = _pages(spark, sf)
    return p.select("page_id", "image", "path", I.file_signature(_content(p)).alias("kind"))


@register("file_signature", W("SELECT page_id, kind FROM sig", SQL_SIG))
def q_file_signature(spark, sf):
    return _signatures(spark, sf).select("page_id", "kind")


@register("file_minus_archives", W("""
SELECT image, path FROM listing WHERE kind = 'f'
  AND (image, path) NOT IN (SELECT (image, path) FROM sig WHERE kind IS NOT NULL)""", SQL_SIG))
def q_file_minus_archives(spark, sf):
    files = _listing(spark, sf).where(F.col("kind") == "f").select("image", "path")
    arch = _signatures(spark, sf).where(F.col("kind").isNotNull())
    return I.file_minus_archives(files, arch, ["image", "path"])


_WORDS = lambda e: f"list_filter(regexp_split_to_array({Q.strip(e)}, '{Q.WS}+'), lambda x: x <> '')"
_LINES = (lambda e: f"(CASE WHEN regexp_split_to_array({e}, '{Q.LB}')[-1] = '' THEN "  # noqa: E731
          f"regexp_split_to_array({e}, '{Q.LB}')[1:len(regexp_split_to_array({e}, '{Q.LB}')) - 1] "
          f"ELSE regexp_split_to_array({e}, '{Q.LB}') END)")


@register("account_names", f"""
SELECT name, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT unnest({_WORDS("split_part(line, ':', 1)")}) AS name FROM (
    SELECT unnest({_LINES('text')}) AS line FROM conversations)) GROUP BY name""")
def q_account_names(spark, sf):
    a = I.account_names(table(spark, sf, "conversations"), "text")
    return a.groupBy("name").agg(F.count("*").cast("bigint").alias("n"))


@register("interface_names", f"""
SELECT name, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT unnest({_WORDS("split_part(line, ':', 2)")}) AS name FROM (
    SELECT CAST(user_id AS VARCHAR) || ': ' || event_type || CAST(user_id AS VARCHAR) || ': <UP> mtu 1500' AS line FROM events
    UNION ALL SELECT props FROM events) WHERE regexp_matches(line, '^[0-9]+:')) GROUP BY name""")
def q_interface_names(spark, sf):
    e = table(spark, sf, "events")
    lines = e.select(F.concat(F.col("user_id").cast("string"), F.lit(": "), "event_type",
                              F.col("user_id").cast("string"), F.lit(": <UP> mtu 1500")).alias("line")) \
             .unionByName(e.select(F.col("props").alias("line")))
    return I.interface_names(lines, "line").groupBy("name").agg(F.count("*").cast("bigint").alias("n"))


KINDS = ["[File]", "[Directory]", "[Executable]", "[GlobalFile]", "[GlobalDirectory]", "[Number]",
         "[PortNumber]", "[Word]", "[Character]", "[Unknown]"]


def _requests(spark, sf):
    p = _pages(spark, sf)
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return p.select(F.col("page_id").alias("req"), "image", I.parent_dir(F.col("path")).alias("cwd"),
                    F.element_at(kinds, (F.col("page_id") % len(KINDS) + 1).cast("int")).alias("placeholder"))


def _cand_sql():
    strings = ", ".join(f"('{k}', '{v}')" for k, vs in I.RANDOM_STRINGS.items() for v in vs)
    kinds = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    local = ", ".join(f"'{x}'" for x in I.LOCAL_RANDOM)
    strs = ", ".join(f"'{x}'" for x in I.RANDOM_STRINGS)
    nums = " ".join(f"WHEN r3.placeholder = '{k}' THEN CAST({lo} + h % {hi - lo + 1} AS VARCHAR)"
                    for k, (lo, hi) in I.NUMBER_RANGES.items())
    numk = ", ".join(f"'{k}'" for k in I.NUMBER_RANGES)
    e = dict(SQL_INV)
    e.update({
        "inv2": f"""SELECT image, coalesce(cwd, '') AS cwd, placeholder, value FROM inv
                    UNION ALL SELECT '', '', placeholder, value FROM (VALUES {strings}) v(placeholder, value)""",
        "rk": """SELECT *, row_number() OVER (PARTITION BY image, cwd, placeholder ORDER BY value) AS i,
                 count(*) OVER (PARTITION BY image, cwd, placeholder) AS n FROM inv2""",
        "cnt": "SELECT image, cwd, placeholder, count(*) AS n FROM inv2 GROUP BY ALL",
        "rq": f"""SELECT page_id AS req, image,
                   CASE WHEN regexp_replace(path, '/[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '/[^/]*$', '') END AS cwd,
                   {kinds}[page_id % {len(KINDS)} + 1] AS placeholder FROM pg""",
        "r2": f"""SELECT req, placeholder, CASE WHEN placeholder IN ({strs}) THEN '' ELSE image END AS kimg,
                   CASE WHEN placeholder IN ({local}) THEN coalesce(cwd, '') ELSE '' END AS kcwd,
                   ('0x' || substr(md5(concat_ws('|', '5', CAST(req AS VARCHAR))), 1, 8))::BIGINT AS h FROM rq""",
        "r3": """SELECT r2.*, CASE WHEN c.n > 0 THEN h % c.n + 1 END AS idx FROM r2 LEFT JOIN cnt c
                 ON c.image = r2.kimg AND c.cwd = r2.kcwd AND c.placeholder = r2.placeholder""",
        "out": f"""SELECT r3.req, r3.placeholder, CASE WHEN r3.placeholder IN ({numk}) THEN (CASE {nums} END)
                     WHEN r3.placeholder = '[Character]' THEN substr('{I.ALNUM}', CAST(h % {len(I.ALNUM)} + 1 AS INTEGER), 1)
                     WHEN rk.value IS NOT NULL THEN rk.value
                     ELSE substr(md5(concat_ws('|', '5', 's', CAST(r3.req AS VARCHAR))), 1, CAST(h % 8 + 1 AS INTEGER)) END AS value
                   FROM r3 LEFT JOIN rk ON rk.image = r3.kimg AND rk.cwd = r3.kcwd AND rk.placeholder = r3.placeholder
                   AND rk.i = r3.idx""",
    })
    return e


@register("placeholder_candidates", W("SELECT req, placeholder, value FROM out", _cand_sql()))
def q_candidates(spark, sf):
    inv = I.path_inventory(_listing(spark, sf))
    return I.placeholder_candidates(_requests(spark, sf), inv, seed=5)
