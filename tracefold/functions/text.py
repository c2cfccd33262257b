"""Scalar text functions as Catalyst expressions (no Python per row).

Python's regex classes are Unicode-aware; Java's need (?U) or explicit
classes.  Whitespace is an explicit class equal to Python's
``str.isspace`` set so strip / collapse / split agree with the
reference's behaviour.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace() accepts, and the line
# boundaries of str.splitlines().
WS_CLASS = (r"[\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
PLACEHOLDER = r"\[[a-zA-Z0-9]+\]"
NUM_MARKER = "<NUM>"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(col) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(_c(col), f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def collapse_ws(col) -> Column:
    return F.regexp_replace(_c(col), f"{WS_CLASS}+", " ")


def split_lines(col) -> Column:
    """``str.splitlines()`` without keepends; trailing break gives no empty tail
    piece that survives, callers drop blank lines anyway."""
    return F.split(_c(col), LINE_BREAK)


def normalise_output(col) -> Column:
    """4+ digit numbers -> <NUM>, drop blank lines, strip, collapse
    whitespace, lower-case; lines joined by \\n.  Null/empty -> ""."""
    s = F.regexp_replace(F.coalesce(_c(col), F.lit("")), r"(?U)\b\d{4,}\b", NUM_MARKER)
    # white space is collapsed first, so the ends are plain blanks: one regex a line
    lines = F.transform(split_lines(s), lambda ln: F.lower(F.trim(collapse_ws(ln))))
    return F.array_join(F.filter(lines, lambda ln: ln != ""), "\n")


def strip_dynamic_env(col) -> Column:
    """Drop lines that contain ``OLDPWD=`` or ``_=`` anywhere."""
    lines = splitlines(_c(col))
    keep = F.filter(lines, lambda ln: ~(ln.contains("OLDPWD=") | ln.contains("_=")))
    return F.array_join(keep, "\n")


def is_placeholder(col) -> Column:
    return _c(col).rlike(PLACEHOLDER)


def placeholders(col) -> Column:
    return F.regexp_extract_all(_c(col), F.lit(f"({PLACEHOLDER})"), 1)


def split_placeholders(col) -> Column:
    """Literals, placeholders and whitespace runs, in order, none dropped
    but empties.  ``as[p1]df[p2] fdf`` -> as,[p1],df,[p2],' ',fdf."""
    pat = rf"({PLACEHOLDER}|{WS_CLASS}+|(?:(?!{PLACEHOLDER}){WS_CLASS.replace('[', '[^', 1)})+)"
    return F.regexp_extract_all(_c(col), F.lit(pat), 1)


def squeeze_sequence(arr2d, suffix: str | Column = "") -> Column:
    """Drop empty args and empty commands, args joined by ' ', commands by
    ' ; ', whitespace collapsed, then the suffix appended."""
    cmds = F.transform(_c(arr2d), lambda cmd: F.filter(cmd, lambda a: F.coalesce(a, F.lit("")) != ""))
    cmds = F.filter(cmds, lambda cmd: F.size(cmd) > 0)
    joined = F.array_join(F.transform(cmds, lambda cmd: F.array_join(cmd, " ")), " ; ")
    squeezed = py_strip(collapse_ws(joined))
    suf = suffix if isinstance(suffix, Column) else F.lit(suffix)
    return F.concat(squeezed, suf)


def flatten_obs(arr2d, delim: str = "\n") -> Column:
    per_cmd = F.transform(_c(arr2d), lambda cmd: py_strip(F.array_join(cmd, " ")))
    return py_strip(F.array_join(per_cmd, delim))


def seq_key(arr) -> Column:
    """Cache key of a command sequence: per command collapse + strip."""
    return F.transform(_c(arr), lambda c: py_strip(collapse_ws(c)))


# The ordered keys of a context snapshot.
CONTEXT_KEYS = ["pwd", "ls", "groups", "env", "set", "shopt", "ulimit", "iptables"]


def split_context(col) -> Column:
    """Wrapper output cut at <del>; first piece dropped; zipped with the
    eight keys on the common length (short output leaves keys absent)."""
    parts = F.split(_c(col), "<del>")
    vals = F.slice(parts, 2, len(CONTEXT_KEYS))
    keys = F.slice(F.array(*[F.lit(k) for k in CONTEXT_KEYS]), 1, F.size(vals))
    return F.map_from_arrays(keys, vals)


def human_format(col) -> Column:
    """floor(n / 1000^k) plus unit, k = floor(log1000 n); 20000 -> 20K."""
    n = _c(col).cast("long")
    units = ["", "K", "M", "G", "T", "P"]
    out = None
    for k in reversed(range(len(units))):
        lo = 1000 ** k
        piece = F.concat((F.floor(n / F.lit(lo))).cast("long").cast("string"), F.lit(units[k]))
        out = F.when(n >= lo, piece) if out is None else out.when(n >= lo, piece)
    return out


def splitlines(col) -> Column:
    """``str.splitlines()``: like split_lines but a trailing break does
    not produce a final empty line ("" -> [])."""
    arr = split_lines(_c(col))
    return F.when(F.element_at(arr, -1) == "", F.slice(arr, 1, F.size(arr) - 1)).otherwise(arr)
