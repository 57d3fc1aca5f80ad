"""Expression texts of artefacts as Columns: a few signs are rewritten, Spark's own parser does the rest."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_QUOTED = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"")
_SIGNS = [(r"&&", " AND "), (r"\|\|", " OR "), (r"==", "="), (r"!(?!=)", " NOT "), (r"\bnil\b", "NULL")]


def _choices(text: str) -> str:
    """``a ? b : c`` as CASE, innermost parentheses first."""
    depth = mark = 0
    for i, sign in enumerate(text):
        depth += (sign == "(") - (sign == ")")
        if sign == "?" and depth == 0:
            mark, nested = i, 0
            for j in range(i + 1, len(text)):
                depth += (text[j] == "(") - (text[j] == ")")
                nested += (text[j] == "?" and depth == 0) - (text[j] == ":" and depth == 0)
                if nested < 0:
                    return f"CASE WHEN {_choices(text[:mark])} THEN {_choices(text[mark + 1 : j])} ELSE {_choices(text[j + 1 :])} END"
            raise ValueError(f"no ':' in {text!r}")
    out, depth, begin = [], 0, 0
    for i, sign in enumerate(text):
        if sign == "(":
            if depth == 0:
                out.append(text[begin : i + 1])
                begin = i + 1
            depth += 1
        elif sign == ")":
            depth -= 1
            if depth == 0:
                out.append(_choices(text[begin:i]))
                begin = i
    return "".join([*out, text[begin:]])


def to_sql(text: str) -> str:
    """SQL text of an expression; quoted strings are left alone."""
    strings: list[str] = []

    def keep(match: re.Match) -> str:
        strings.append("'" + match[0][1:-1].replace("'", "\\'") + "'")
        return f"\x00{len(strings) - 1}\x00"

    text = _QUOTED.sub(keep, text)
    for sign, by in _SIGNS:
        text = re.sub(sign, by, text)
    return re.sub("\x00(\\d+)\x00", lambda m: strings[int(m[1])], _choices(text))


def expression(text: str) -> Column:
    """Value of an expression text; null operands give null."""
    return F.expr(to_sql(text))


def truth(text: str) -> Column:
    """A boolean expression text; false where it is null."""
    return F.coalesce(expression(text).cast("boolean"), F.lit(False))
