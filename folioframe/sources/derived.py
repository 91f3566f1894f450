"""Page geometry derived from the text of ordinary tables, the same on any engine: integer arithmetic on ids and line numbers.

Each line of a document is a block: 20 lines a page, 14 points apart, three indents, six font sizes and names by rule, and
some lines decorated so that lists, code, tables, notes and headings occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import DUCK, SPARK, Engine

LINES_PER_PAGE, LINE_STEP, TOP = 20, 14, 780
SIZES = ("12.0", "12.0", "12.0", "16.0", "24.0", "10.0")
FONTS = ("Helvetica", "Helvetica", "Helvetica-Bold", "ABCDEF+Times-Italic", "CMMI10", "Courier")


def decorated(e: Engine, line: str, n: str) -> str:
    mark = f"substr(md5({line}), 1, 8)"  # short, and made from the whole line
    rules = [f"concat('1. Part ', {mark})", f"concat('2.1 Section ', {mark})", f"concat('• ', {line})", f"concat('- ', {line})", f"concat('NOTE ', {line})", f"concat('func ', {mark}, '() {{')", f"replace({line}, ' ', '    ')", "'RELATED WORK'", f"concat('a = b + c ', {mark}, ' (1)')", f"concat('12    ', {line}, '    34')"]
    when = " ".join(f"when {k} then {r}" for k, r in enumerate(rules))
    return f"case ({n}) % 29 {when} else {line} end"


def columns(e: Engine) -> dict[str, str]:
    """From doc_id, ln and line."""
    n = "(ln * 5 + doc_id)"
    size = e.pick([f"cast({s} as double)" for s in SIZES], "(ln + doc_id) % 6")
    length = "char_length" if e.name == "spark" else "length"
    return {
        "page": f"cast(ln {e.div} {LINES_PER_PAGE} as int)", "ord": "cast(ln as int)", "text": decorated(e, "line", n),
        "x": "cast(72 + 24 * ((ln * 7 + doc_id) % 3) as double)", "y": f"cast({TOP} - {LINE_STEP} * (ln % {LINES_PER_PAGE}) as double)",
        "font_size": size, "font_name": e.pick([f"'{f}'" for f in FONTS], "(ln * 3 + doc_id) % 6"),
        "width": f"0.5 * {size} * {length}({decorated(e, 'line', n)})", "height": size, "space_width": f"0.25 * {size}",
    }


def text_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, page, ord, text, x, y, font_size, font_name, width, height, space_width."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ln", "line"))
    return lines.select("doc_id", *(F.expr(sql).alias(c) for c, sql in columns(SPARK).items()))


#: The same rows in DuckDB, as common table expressions that queries may follow.
SQL = (
    "with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as ln from documents),\n"
    "blocks as (select doc_id, " + ", ".join(f"{sql} as {c}" for c, sql in columns(DUCK).items()) + " from l)"
)
