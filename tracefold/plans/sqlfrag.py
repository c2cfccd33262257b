"""DuckDB SQL fragments shared by oracle queries (RE2 has no lookaround
and ASCII-only classes, so Unicode rules are spelled out)."""

from __future__ import annotations

WS = (r"[\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
LB = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
WORD = r"[\pL\pN\pM_]"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"


def normalise(e: str) -> str:
    nonword = WORD.replace("[", "[^", 1)
    num = f"regexp_replace(coalesce({e}, ''), '(^|{nonword})[0-9]{{4,}}($|{nonword})', '\\1<NUM>\\2', 'g')"
    num = f"regexp_replace({num}, '(^|{nonword})[0-9]{{4,}}($|{nonword})', '\\1<NUM>\\2', 'g')"
    lines = f"regexp_split_to_array({num}, '{LB}')"
    kept = f"list_filter({lines}, lambda ln: {strip('ln')} <> '')"
    return (f"array_to_string(list_transform({kept}, lambda ln: "
            f"lower(regexp_replace({strip('ln')}, '{WS}+', ' ', 'g'))), chr(10))")


def lcs_ctes(src: str) -> dict[str, str]:
    """CTEs computing ``lcs(pid, lcs)`` for a relation ``src(pid, a, b)`` of
    two texts that are not empty, by anti-diagonals: step d holds the table's
    entries (i, d - i) for every i, from the two diagonals before."""
    return {
        "lcs_src": f"""SELECT pid, string_split(a, '') AS ca, string_split(b, '') AS cb, length(a) AS n, length(b) AS m FROM {src}""",
        "lcs_rec": """
SELECT pid, 0 AS d, list_transform(range(0, n + 1), lambda i: 0) AS p2, list_transform(range(0, n + 1), lambda i: 0) AS p1 FROM lcs_src
UNION ALL
SELECT r.pid, r.d + 1, r.p1, list_transform(range(0, s.n + 1), lambda i: CASE WHEN i = 0 OR i > r.d OR r.d + 1 - i > s.m THEN 0
         WHEN s.ca[i] = s.cb[r.d + 1 - i] THEN r.p2[i] + 1 ELSE greatest(r.p1[i], r.p1[i + 1]) END)
FROM lcs_rec r JOIN lcs_src s ON r.pid = s.pid WHERE r.d < s.n + s.m""",
        "lcs": "SELECT r.pid, r.p1[s.n + 1] AS lcs FROM lcs_rec r JOIN lcs_src s ON r.pid = s.pid WHERE r.d = s.n + s.m",
    }


def indel(pairs: str) -> dict[str, str]:
    """CTEs giving ``sims(pid, sim)`` for a relation ``pairs(pid, a, b)``."""
    return {
        "lcs_in": f"SELECT pid, a, b FROM {pairs} WHERE a <> b AND a <> '' AND b <> ''",
        **lcs_ctes("lcs_in"),
        "sims": f"""SELECT p.pid, CASE WHEN p.a = p.b THEN 1.0 WHEN l.lcs IS NULL THEN 0.0
                    ELSE 2.0 * l.lcs / (length(p.a) + length(p.b)) END::DOUBLE AS sim FROM {pairs} p LEFT JOIN lcs l ON l.pid = p.pid""",
    }
