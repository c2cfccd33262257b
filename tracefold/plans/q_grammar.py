"""Queries over a grammar derived from the documents table.

Grammar (grows with the data): [Input] and [Command] -> one command
[<lang>] per language; [<lang>] -> "<lang> [<lang>Options]"; options are
"-<word>" flags for all words (runs of letters) of the texts, "--<source>
[<source>Val]" nested nonterminals and one placeholder of each kind;
[<source>Val] -> the source's words and [Number].
Ordinals follow first appearance (doc_id), ties by text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold.functions import text as T
from tracefold.operators import grammar as G
from tracefold.operators import inventory as I
from tracefold.operators import vocab as VO
from tracefold.operators.numbering import global_rank
from tracefold.plans import fixtures as V
from tracefold.plans.q_inventory import SQL_INV, _listing, _pages
from tracefold.plans.registry import register
from tracefold.session import cut_lineage, scratch_path, stored
from tracefold.sources.tables import table

FIXED_OPTIONS = ["[File]", "[Number]", "[Word]", "[Username]"]


def derived_grammar(spark, sf):
    """One pass over the texts: their distinct words by (lang, source) with
    the first document of each, stored once; every production is a branch of
    that table's rows (a source's words, a language's words) or of the
    (lang, source) pairs in it (word null)."""
    docs = table(spark, sf, "documents")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1))
    pair = F.array(F.lit(None).cast("string"))  # the pair itself, with or without words
    seen = docs.select("doc_id", "lang", "source", F.explode_outer(F.concat(pair, F.coalesce(words, F.array().cast("array<string>")))).alias("fw"))  # never empty; the outer form cuts each text up once
    seen = stored(seen.groupBy("lang", "source", "fw").agg(F.min("doc_id").alias("first")), "words-seen")  # first appearances are enough
    lang, source, fw = F.col("lang"), F.col("source"), F.col("fw")
    br = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    rule = lambda head, production: F.struct(head.alias("nonterminal"), production.alias("production"))
    options, value = br("[", lang, "Options]"), br("[", source, "Val]")
    of_word = F.array(rule(options, br("-", fw)), rule(value, fw))
    of_pair = F.array(rule(F.lit("[Input]"), br("[", lang, "]")), rule(F.lit("[Command]"), br("[", lang, "]")),
                      rule(br("[", lang, "]"), br(lang, " [", lang, "Options]")), rule(options, br("--", source, " [", source, "Val]")),
                      rule(value, F.lit("[Number]")), *[rule(options, F.lit(p)) for p in FIXED_OPTIONS])
    u = seen.select("first", F.explode(F.when(fw.isNull(), of_pair).otherwise(of_word)).alias("_r")).select("first", "_r.*")
    u = u.where("nonterminal is not null and production is not null").groupBy("nonterminal", "production").agg(F.min("first").alias("first"))
    g = global_rank(u, ["first", "production"], out="_o", group=["nonterminal"], narrow=False)
    # used several times per query (actions, heads, repeats, masks): materialise once
    return stored(g.select("nonterminal", (F.col("_o") - 1).cast("int").alias("ordinal"), "production"), "grammar")


def commands(grammar):
    return grammar.where(F.col("nonterminal") == "[Input]").select("ordinal", "production")


SQL_GRAMMAR = {
    "gw": r"""SELECT doc_id, lang, source, unnest(list_distinct(regexp_extract_all(lower(text), '\p{L}+'))) AS fw FROM documents""",
    "gd": "SELECT doc_id, lang, source FROM documents",
    "gp": """
SELECT '[Input]' AS nonterminal, '[' || lang || ']' AS production, min(doc_id) AS first FROM gd GROUP BY lang
UNION ALL SELECT '[Command]', '[' || lang || ']', min(doc_id) FROM gd GROUP BY lang
UNION ALL SELECT '[' || lang || ']', lang || ' [' || lang || 'Options]', min(doc_id) FROM gd GROUP BY lang
UNION ALL SELECT '[' || lang || 'Options]', '-' || fw, min(doc_id) FROM gw GROUP BY lang, fw
UNION ALL SELECT '[' || lang || 'Options]', '--' || source || ' [' || source || 'Val]', min(doc_id) FROM gd GROUP BY lang, source
UNION ALL SELECT '[' || lang || 'Options]', p, min(doc_id) FROM gd, (VALUES ('[File]'), ('[Number]'), ('[Word]'), ('[Username]')) v(p) GROUP BY lang, p
UNION ALL SELECT '[' || source || 'Val]', fw, min(doc_id) FROM gw GROUP BY source, fw
UNION ALL SELECT '[' || source || 'Val]', '[Number]', min(doc_id) FROM gd GROUP BY source""",
    "grammar": """
SELECT nonterminal, CAST(row_number() OVER (PARTITION BY nonterminal ORDER BY first, production) - 1 AS INTEGER) AS ordinal,
       production FROM (SELECT nonterminal, production, min(first) AS first FROM gp
                  WHERE nonterminal IS NOT NULL AND production IS NOT NULL GROUP BY nonterminal, production)""",
}


def with_grammar(body: str, extra: dict | None = None) -> str:
    e = dict(SQL_GRAMMAR)
    e.update(extra or {})
    return V.with_views(body, extra=e)


@register("read_grammar", with_grammar("SELECT nonterminal, ordinal, production FROM grammar"))
def q_read_grammar(spark, sf):
    g = derived_grammar(spark, sf)
    path = scratch_path(spark, "grammar")
    G.write_grammar(g.where(~F.col("nonterminal").isin("[Input]", "[Command]")), path)
    return G.read_grammar(spark, path, commands=commands(g))


_REPEAT_VALUES = ", ".join(f"('{x}')" for x in G.REPEAT_FILE)
SQL_REPEATS = f"""
SELECT nonterminal FROM (VALUES {_REPEAT_VALUES}) v(nonterminal)
UNION SELECT '[' || regexp_replace(production, '^\\[|\\]$', '', 'g') || 'Options]' FROM grammar
WHERE nonterminal = '[Input]'
  AND '[' || regexp_replace(production, '^\\[|\\]$', '', 'g') || 'Options]' IN (SELECT nonterminal FROM grammar)"""


def _repeats(spark, g):
    rf = spark.createDataFrame([(x,) for x in G.REPEAT_FILE], "nonterminal string")
    return G.repeat_set(g, rf, commands(g))


@register("repeat_set", with_grammar("SELECT nonterminal FROM rep", {"rep": SQL_REPEATS}))
def q_repeat_set(spark, sf):
    return _repeats(spark, derived_grammar(spark, sf))


@register("placeholder_extract", with_grammar("""
SELECT nonterminal, ordinal, CAST(unnest(range(0, len(ph))) AS INTEGER) AS pos, unnest(ph) AS placeholder
FROM (SELECT *, regexp_extract_all(production, '(\\[[a-zA-Z0-9]+\\])', 1) AS ph FROM grammar)"""))
def q_placeholder_extract(spark, sf):
    return G.placeholder_occurrences(derived_grammar(spark, sf))


def _split_sql(e: str) -> str:
    from tracefold.plans import sqlfrag as Q
    marked = f"regexp_replace({e}, '(\\[[a-zA-Z0-9]+\\]|{Q.WS}+)', chr(1) || '\\1' || chr(1), 'g')"
    return f"list_filter(string_split({marked}, chr(1)), lambda x: x <> '')"


@register("placeholder_split", with_grammar(f"""
SELECT nonterminal, ordinal, array_to_string({_split_sql('production')}, chr(31)) AS pieces FROM grammar"""))
def q_placeholder_split(spark, sf):
    g = derived_grammar(spark, sf)
    return g.select("nonterminal", "ordinal", F.array_join(T.split_placeholders("production"), "\x1f").alias("pieces"))


SQL_BFS = {
    "ed": """SELECT nonterminal AS parent, ordinal, pos, ph AS child FROM (
      SELECT nonterminal, ordinal, unnest(range(0, len(p))) AS pos, unnest(p) AS ph
      FROM (SELECT *, regexp_extract_all(production, '(\\[[a-zA-Z0-9]+\\])', 1) AS p FROM grammar))
    WHERE ph IN (SELECT nonterminal FROM grammar)""",
    "el": "SELECT list(struct_pack(parent := parent, ordinal := ordinal, pos := pos, child := child)) AS e FROM ed",
    "bfs_rec": """
SELECT 0 AS level, ['[Input]'] AS visited, ['[Input]'] AS frontier
UNION ALL
SELECT level + 1, list_concat(visited, nw), nw FROM (
  SELECT level, visited, list_transform(list_filter(c, lambda x, i: NOT list_contains(
           list_transform(c[1:i - 1], lambda y: y.child), x.child)), lambda x: x.child) AS nw
  FROM (SELECT b.level, b.visited, list_sort(list_transform(list_filter(el.e, lambda x:
           list_contains(b.frontier, x.parent) AND NOT list_contains(b.visited, x.child)),
           lambda x: struct_pack(pr := list_position(b.visited, x.parent), o := x.ordinal, p := x.pos, child := x.child))) AS c
        FROM bfs_rec b, el WHERE len(b.frontier) > 0))
WHERE len(nw) > 0""",
    "reach": """SELECT unnest(visited) AS nonterminal, CAST(unnest(range(1, len(visited) + 1)) AS BIGINT) AS reach_rank
FROM bfs_rec QUALIFY row_number() OVER (ORDER BY level DESC) = 1""",
}


@register("reachable_nonterminals", with_grammar("""
SELECT r.nonterminal, r.reach_rank FROM reach r WHERE r.nonterminal IN (SELECT nonterminal FROM grammar)""", SQL_BFS))
def q_reachable(spark, sf):
    r = G.reachable_nonterminals(derived_grammar(spark, sf), "[Input]")
    return r.select("nonterminal", "reach_rank")


_UNL = ", ".join(f"'{x}'" for x in G.UNLEARNED)
SQL_HEADS = {
    "occ": """SELECT nonterminal, unnest(regexp_extract_all(production, '(\\[[a-zA-Z0-9]+\\])', 1)) AS ph FROM grammar""",
    "h_rec": f"""SELECT '[Input]' AS head UNION
SELECT o.ph FROM h_rec h JOIN occ o ON o.nonterminal = h.head WHERE o.ph NOT IN ({_UNL})""",
    "heads": f"SELECT head FROM h_rec WHERE head NOT IN ({_UNL})",
}


@register("expansion_heads", with_grammar("SELECT head FROM heads", SQL_HEADS))
def q_heads(spark, sf):
    return G.expansion_heads(derived_grammar(spark, sf), "[Input]")


SQL_ACTIONS = dict(SQL_BFS)
SQL_ACTIONS["acts"] = """
SELECT production, CAST(row_number() OVER (ORDER BY rr, o) - 1 AS BIGINT) AS action_id FROM (
  SELECT g.production, min(struct_pack(rr := r.reach_rank, o := g.ordinal)) AS k FROM grammar g JOIN reach r
  ON g.nonterminal = r.nonterminal GROUP BY g.production) x, LATERAL (SELECT x.k.rr AS rr, x.k.o AS o)"""


def _actions(spark, g):
    reach = G.reachable_nonterminals(g, "[Input]")
    return G.production_actions(g, reach)


@register("production_actions", with_grammar("SELECT production, action_id FROM acts", SQL_ACTIONS))
def q_actions(spark, sf):
    return _actions(spark, derived_grammar(spark, sf))


SQL_MASK = dict(SQL_ACTIONS)
SQL_MASK.update(SQL_HEADS)
SQL_MASK["rep"] = SQL_REPEATS


@register("production_mask", with_grammar("""
SELECT DISTINCT h.head, a.action_id FROM heads h JOIN grammar g ON g.nonterminal = h.head JOIN acts a ON a.production = g.production
UNION SELECT h.head, (SELECT count(*) FROM acts) FROM heads h WHERE h.head IN (SELECT nonterminal FROM rep)
  AND h.head IN (SELECT nonterminal FROM grammar)""", SQL_MASK))
def q_mask(spark, sf):
    g = derived_grammar(spark, sf)
    m = G.production_mask(g, _actions(spark, g), G.expansion_heads(g), _repeats(spark, g))
    return m.select("head", F.col("action_id").cast("bigint").alias("action_id"))


def _mask2_sql(strict: bool) -> str:
    other_filter = "AND h.head NOT IN (SELECT nonterminal FROM grammar)" if strict else ""
    return with_grammar(f"""
SELECT head, n_own, allows_free, allows_terminal,
  CAST(n_own + CASE WHEN allows_free THEN (SELECT count(*) FROM acts) - (SELECT count(*) FROM reserved) ELSE 0 END
       + CASE WHEN allows_terminal THEN 1 ELSE 0 END AS BIGINT) AS n_allowed
FROM (
  SELECT h.head, CAST((SELECT count(DISTINCT a.action_id) FROM grammar g JOIN acts a ON a.production = g.production
                       WHERE g.nonterminal = h.head) AS BIGINT) AS n_own, false AS allows_free, false AS allows_terminal
  FROM heads h WHERE h.head IN (SELECT head FROM starting)
  UNION ALL
  SELECT h.head, 0, true, h.head IN (SELECT nonterminal FROM rep) FROM heads h
  WHERE h.head NOT IN (SELECT head FROM starting) {other_filter}
  UNION ALL
  SELECT h.head, 0, false, false FROM heads h
  WHERE h.head NOT IN (SELECT head FROM starting) {'AND h.head IN (SELECT nonterminal FROM grammar)' if strict else 'AND false'})""",
        dict(SQL_MASK, starting="SELECT production AS head FROM grammar WHERE nonterminal = '[Input]' UNION SELECT '[Input]'",
             reserved="""SELECT DISTINCT g.production FROM grammar g WHERE g.nonterminal IN (SELECT head FROM starting)
                         AND g.nonterminal IN (SELECT head FROM heads) AND g.production IN (SELECT production FROM acts)"""))


def _mask2(spark, sf, strict):
    g = derived_grammar(spark, sf)
    m = G.production_mask_2layer(g, _actions(spark, g), G.expansion_heads(g), _repeats(spark, g),
                                 strict_reference=strict)
    return m.select("head", F.size("own_actions").cast("bigint").alias("n_own"), "allows_free", "allows_terminal",
                    F.col("n_allowed").cast("bigint").alias("n_allowed"))


@register("production_mask_2layer", _mask2_sql(False))
def q_mask2(spark, sf):
    return _mask2(spark, sf, False)


@register("production_mask_2layer_strict", _mask2_sql(True))
def q_mask2_strict(spark, sf):
    return _mask2(spark, sf, True)


SQL_STARTING = dict(SQL_MASK, starting="SELECT production AS head FROM grammar WHERE nonterminal = '[Input]' UNION SELECT '[Input]'",
                    reserved="""SELECT DISTINCT g.production FROM grammar g WHERE g.nonterminal IN (SELECT head FROM starting)
                         AND g.nonterminal IN (SELECT head FROM heads) AND g.production IN (SELECT production FROM acts)""",
                    hr="SELECT head, row_number() OVER (ORDER BY head) - 1 AS r FROM heads",
                    req="""SELECT h.head, a.action_id FROM acts a JOIN hr h ON a.action_id % (SELECT count(*) FROM heads) = h.r
                           UNION ALL SELECT head, (SELECT count(*) FROM acts) FROM heads""")


@register("mask_membership", with_grammar("""
SELECT q.head, q.action_id, CASE
    WHEN q.head IN (SELECT head FROM starting) THEN a.production IS NOT NULL AND (q.head, a.production) IN (SELECT (nonterminal, production) FROM grammar)
    WHEN a.production IS NULL THEN q.head IN (SELECT nonterminal FROM rep)
    ELSE a.production NOT IN (SELECT production FROM reserved) END AS allowed
FROM req q LEFT JOIN acts a ON a.action_id = q.action_id""", SQL_STARTING))
def q_membership(spark, sf):
    """Requests: every action for one head, dealt round, and the terminal
    action for every head."""
    g = derived_grammar(spark, sf)
    actions, heads = _actions(spark, g), cut_lineage(G.expansion_heads(g))
    m = G.production_mask_2layer(g, actions, heads, _repeats(spark, g))
    n_actions, n_heads = actions.count(), heads.count()  # two scalars
    rank = global_rank(heads, ["head"], out="_r")
    asked = actions.select("action_id", (F.col("action_id") % max(n_heads, 1) + 1).alias("_r")).join(rank, "_r").select("head", "action_id")
    asked = asked.unionByName(heads.select("head", F.lit(n_actions).cast("long").alias("action_id")))
    starting = g.where("nonterminal = '[Input]'").select(F.col("production").alias("nonterminal")).unionByName(spark.createDataFrame([("[Input]",)], "nonterminal string"))
    own = g.join(starting, "nonterminal", "left_semi").join(heads.withColumnRenamed("head", "nonterminal"), "nonterminal", "left_semi")
    reserved = actions.join(own.select("production").distinct(), "production", "left_semi").select("action_id")
    return G.mask_allows(m, asked, actions, reserved, n_actions).select("head", "action_id", "allowed")


# ------------------------------------------------------------------ vocabulary

def _dirs(spark, sf):
    """Working directories: the URL paths of the pages, in first-seen order."""
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1).alias("dir"))
    return p.groupBy("dir").agg(F.min("page_id").alias("ord"))


def _vocab(spark, sf):
    values = I.path_inventory(_listing(spark, sf)).select("value").distinct()
    return VO.build_vocabulary(derived_grammar(spark, sf), dirs=_dirs(spark, sf), inventory=values)


def _printable_sql() -> str:
    rows = [f"(chr({ord(c)}), 1, {i})" for i, c in enumerate(VO.PRINTABLE)]
    rows = [f"('{t}', 0, {i})" for i, t in enumerate(VO.SPECIALS)] + rows
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") v(token, sec, a)"


def _vocab_sql() -> dict:
    from tracefold.plans import sqlfrag as Q
    return {
        **SQL_INV,
        "fx": _printable_sql(),
        "pc": f"""SELECT nonterminal, ordinal, pos, {Q.strip('piece')} AS token FROM (
                  SELECT nonterminal, ordinal, unnest(range(0, len(ps))) AS pos, unnest(ps) AS piece
                  FROM (SELECT *, {_split_sql('production')} AS ps FROM grammar))""",
        "dr": """SELECT dir, min(page_id) AS ord FROM (SELECT page_id, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS dir
                 FROM pages) GROUP BY dir""",
        "vu": """SELECT token, 0 AS sec, '' AS s, CAST(a AS BIGINT) AS a, CAST(0 AS BIGINT) AS b FROM fx WHERE sec = 0
           UNION ALL SELECT token, 1, '', a, 0 FROM fx WHERE sec = 1
           UNION ALL SELECT token, 2, nonterminal, ordinal, pos FROM pc
                     WHERE token <> '' AND NOT regexp_matches(token, '\\[[a-zA-Z0-9]+\\]')
           UNION ALL SELECT unnest(string_split(dir, '/')) AS token, 3, '', ord, unnest(range(0, len(string_split(dir, '/')))) FROM dr
           UNION ALL SELECT value, 4, value, 0, 0 FROM (SELECT DISTINCT value FROM inv)""",
        "vocab": """SELECT token, CAST(row_number() OVER (ORDER BY k.sec, k.s, k.a, k.b) - 1 AS BIGINT) AS id FROM (
                    SELECT token, min(struct_pack(sec := sec, s := s, a := a, b := b)) AS k FROM vu GROUP BY token)""",
    }


@register("build_vocabulary", with_grammar("SELECT token, id FROM vocab", _vocab_sql()))
def q_vocab(spark, sf):
    return _vocab(spark, sf)


def _encoded(spark, sf, vocab):
    t = V.traces(spark, sf).select(F.col("seq").alias("id"), "input")
    return VO.encode_greedy(t, "input", vocab, key="id")


def _encode_sql() -> dict:
    from tracefold.plans import sqlfrag as Q
    words = f"list_filter(regexp_split_to_array(input, '{Q.WS}+'), lambda x: x <> '')"
    e = dict(_vocab_sql())
    e.update({"tw": f"""SELECT seq, unnest(range(0, len(w))) AS wpos, unnest(w) AS word FROM (
                        SELECT seq, {words} AS w FROM traces)""",
              "uw": "SELECT DISTINCT word FROM tw",
              "sb": """SELECT word, i, n, substr(word, i, n) AS token FROM (
                       SELECT word, i, unnest(range(1, length(word) - i + 2)) AS n FROM (
                       SELECT word, unnest(range(1, length(word) + 1)) AS i FROM uw))""",
              "hits": """SELECT uw.word, coalesce(list(struct_pack(i := sb.i, n := sb.n, tid := v.id))
                                 FILTER (WHERE v.id IS NOT NULL), []) AS hits
                         FROM uw LEFT JOIN sb ON sb.word = uw.word LEFT JOIN vocab v ON v.token = sb.token GROUP BY uw.word""",
              "enc": """SELECT word, list_reduce(range(1, length(word) + 1), lambda acc, pos: CASE WHEN pos <> acc.cur THEN acc ELSE
                        struct_pack(cur := pos + coalesce(list_max(list_transform(list_filter(hits, lambda h: h.i = pos), lambda h: h.n)), 1),
                          ids := list_append(acc.ids, coalesce(list_filter(hits, lambda h: h.i = pos AND h.n =
                            list_max(list_transform(list_filter(hits, lambda h2: h2.i = pos), lambda h2: h2.n)))[1].tid, 1)))
                        END, struct_pack(cur := 1, ids := CAST([] AS BIGINT[]))).ids AS wids FROM hits""",
              "encoded": """SELECT t.seq AS id, coalesce(flatten(list(e.wids ORDER BY t.wpos)), []) AS ids
                            FROM (SELECT DISTINCT seq FROM traces) s LEFT JOIN tw t ON t.seq = s.seq
                            LEFT JOIN enc e ON e.word = t.word GROUP BY t.seq"""})
    return e


@register("encode_greedy", with_grammar("""
SELECT s.seq AS id, array_to_string(list_transform(coalesce(e.ids, []), lambda x: CAST(x AS VARCHAR)), ',') AS ids
FROM (SELECT DISTINCT seq FROM traces) s LEFT JOIN encoded e ON e.id = s.seq""",
                                        dict(traces=V.SQL["traces"], **_encode_sql())))
def q_encode(spark, sf):
    e = _encoded(spark, sf, stored(_vocab(spark, sf), "vocabulary"))  # read by whole words, markers and matches
    return e.select("id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@register("decode_ids", with_grammar("""
SELECT s.seq AS id, coalesce(d.text, '') AS text FROM (SELECT DISTINCT seq FROM traces) s LEFT JOIN (
  SELECT e.id, string_agg(coalesce(v.token, '<unk>'), ' ' ORDER BY x.pos) AS text FROM encoded e,
    LATERAL (SELECT unnest(e.ids) AS tid, unnest(range(0, len(e.ids))) AS pos) x
    LEFT JOIN vocab v ON v.id = x.tid WHERE x.tid <> 0 GROUP BY e.id) d ON d.id = s.seq""",
                                     dict(traces=V.SQL["traces"], **_encode_sql())))
def q_decode(spark, sf):
    vocab = stored(_vocab(spark, sf), "vocabulary")  # one vocabulary for both directions
    return VO.decode_ids(_encoded(spark, sf, vocab), "ids", vocab, key="id")


@register("derive_commands")  # random synthesis over a data-sized grammar: rows-only + golden tests
def q_derive(spark, sf):
    from tracefold.operators.derive import derive_commands
    g = derived_grammar(spark, sf)
    inv = cut_lineage(I.path_inventory(_listing(spark, sf)))
    pages = _pages(spark, sf).select("page_id", "image", I.parent_dir(F.col("path")).alias("cwd"))
    n = pages.agg(F.max("page_id")).first()[0] or 0  # a scalar
    req = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit(11).alias("seed"), (F.col("doc_id") % (n + 1)).alias("page_id"))
    req = req.join(pages, "page_id", "left").drop("page_id")  # each command runs in some page's image and directory
    d = derive_commands(g, req, _repeats(spark, g), max_args=10, inventory=inv, early_stop=5, fill_seed=11)
    return d.select("id", "command", F.size("args").alias("n_parts"), "n_args", "rounds")
