"""Text expressions: keyword-line parsing (P1, P2), labels from file names.

All JVM-side regular expressions.  The whitespace class is written out so
that Spark (Java regex) and the SQL oracle (RE2) agree with Python's
``str.split()`` / ``str.strip()`` whitespace, including the no-break space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace() treats as whitespace.
WS_CLASS = (r"\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WS = f"[{WS_CLASS}]"
NON_WS = f"[^{WS_CLASS}]"
# id token, then at least one whitespace, then the rest without outer whitespace
KEYWORD_LINE = f"(?s)^{WS}*({NON_WS}+){WS}+(.*?){WS}*$"
INTEGER_TOKEN = r"^[+-]?[0-9]+$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def keyword_id_token(line) -> Column:
    return F.regexp_extract(_col(line), KEYWORD_LINE, 1)


def keyword_text(line) -> Column:
    return F.regexp_extract(_col(line), KEYWORD_LINE, 2)


def keyword_id(line) -> Column:
    """The id as bigint, NULL when the token is not an integer."""
    tok = keyword_id_token(line)
    return F.when(tok.rlike(INTEGER_TOKEN), tok.try_cast("long"))


def label_from_file(name, prefix: str = "") -> Column:
    """File name without directory and without ``.csv``, with a prefix."""
    base = F.regexp_extract(_col(name), r"([^/]+)$", 1)
    stem = F.regexp_replace(base, r"\.csv$", "")
    return F.concat(F.lit(prefix), stem) if prefix else stem


def py_strip(c) -> Column:
    """D3: strip leading/trailing whitespace like Python's str.strip()."""
    return F.regexp_replace(_col(c), f"^{WS}+|{WS}+$", "")
