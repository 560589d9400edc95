"""Query generation from entity names.

Each entity name yields its cleaned base (``List_of_`` removed, ``_`` as
blanks) and the variants of the first rule whose pattern it contains
(case-sensitive).  Rules are data (pattern, templates) and compile into one
``CASE WHEN`` chain, so expansion is a per-row JVM expression and a
``posexplode``; duplicates keep their first position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Expansion rules in their order of precedence (first match wins).
# Placeholders: {year} = the name's text before the first "_";
# {frat} = the cleaned base with " chapters" removed.
EXPANSION_RULES = [
    ("World_Cup", ["{year} football tournament players", "FIFA football cup squads from {year}"]),
    ("Harvard", ["Harvard alumni in Massachusetts", "famous Harvard University professors"]),
    ("chapters", ["{frat} college fraternity chapters", "American college fraternity {frat}"]),
    ("Basketball", ["NCAA basketball tournament brackets"]),
    ("Fighting_Illini", ["Illinois college basketball team players"]),
]
MAX_VARIANTS = 1 + max(len(t) for _, t in EXPANSION_RULES)


def clean_base(name) -> Column:
    return F.replace(F.replace(name, F.lit("List_of_"), F.lit("")), F.lit("_"), F.lit(" "))


def _fill(template: str, year: Column, frat: Column) -> Column:
    parts: list[Column] = []
    rest = template
    while rest:
        i_y, i_f = rest.find("{year}"), rest.find("{frat}")
        cands = [(i, tag) for i, tag in ((i_y, "y"), (i_f, "f")) if i >= 0]
        if not cands:
            parts.append(F.lit(rest))
            break
        i, tag = min(cands)
        if i:
            parts.append(F.lit(rest[:i]))
        parts.append(year if tag == "y" else frat)
        rest = rest[i + 6:]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def variants(name_col: str = "entity", rules=None) -> Column:
    """array of query strings for one entity: base first, then the variants."""
    rules = rules or EXPANSION_RULES
    name = F.col(name_col)
    base = clean_base(name)
    year = F.split(name, "_", -1).getItem(0)
    frat = F.replace(base, F.lit(" chapters"), F.lit(""))
    expr = None
    for pattern, templates in rules:
        arr = F.array(base, *[_fill(t, year, frat) for t in templates])
        cond = name.contains(pattern)
        expr = F.when(cond, arr) if expr is None else expr.when(cond, arr)
    return expr.otherwise(F.array(base)) if expr is not None else F.array(base)


def expand(entities: DataFrame, name_col: str = "entity", ord_col: str = "ord", rules=None) -> DataFrame:
    """D4 + U2: (query, ord) distinct queries at their first position, where
    ord = entity ord * MAX_VARIANTS + variant index."""
    ex = entities.select(F.col(ord_col).alias("_eo"), F.posexplode(variants(name_col, rules)).alias("_v", "query"))
    ex = ex.select("query", (F.col("_eo") * MAX_VARIANTS + F.col("_v")).cast("long").alias("ord"))
    return ex.groupBy("query").agg(F.min("ord").alias("ord"))
