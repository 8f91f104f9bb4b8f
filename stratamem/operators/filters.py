"""The boolean metadata filter language, compiled to Column predicates.

    expr := block (OR block)* ; block := clause (AND clause)*
    clause := field op value | CONTAINS(field, 'text') ; op := = != < <= > >=

AND binds tighter than OR, keywords are case-insensitive, text in quotes is
never split. `=` is lenient: it compares as a number if the value is one, as
text (booleans as true/false), or as membership in an array. `!=` is its
complement over all rows, so rows without the field match. Order comparisons are
numeric only: text fields never match. Empty clauses are skipped.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"""\s*(?:(?P<quoted>'[^']*'|"[^"]*")|(?P<op><=|>=|!=|=|<|>)|(?P<paren>[(),])|(?P<word>[^\s=<>!(),'"]+))""")


@dataclass(frozen=True)
class Clause:
    field: str
    op: str
    value: str
    quoted: bool = False


@dataclass(frozen=True)
class Filter:
    """Alternatives of clauses that must all hold, and the full-text clause taken out of them."""

    blocks: tuple[tuple[Clause, ...], ...]
    contains: tuple[str, str] | None = None


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected character in the filter: {text[at:].strip()[:10]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def parse(text: str) -> Filter:
    """Parses a filter. ValueError for one that is empty or malformed."""
    if not text.strip():
        raise ValueError("the filter is empty")
    tokens = _tokens(text)
    blocks, block, contains, i = [], [], None, 0
    value = lambda t: t[1][1:-1] if t[0] == "quoted" else t[1]
    while i < len(tokens):
        kind, word = tokens[i]
        upper = word.upper() if kind == "word" else ""
        if upper == "AND":
            i += 1
        elif upper == "OR":
            blocks.append(tuple(block))
            block = []
            i += 1
        elif upper == "CONTAINS" and [t[1] for t in tokens[i + 1 : i + 6 : 2]] == ["(", ",", ")"]:
            if contains is None:  # the first is the text query, later ones add nothing
                contains = (value(tokens[i + 2]), value(tokens[i + 4]))
            i += 6
        elif kind in ("word", "quoted") and i + 2 < len(tokens) and tokens[i + 1][0] == "op" and tokens[i + 2][0] in ("word", "quoted"):
            op, raw = tokens[i + 1][1], tokens[i + 2]
            i += 3
            words = [value(raw)]
            while raw[0] == "word" and i < len(tokens) and tokens[i][0] == "word" and tokens[i][1].upper() not in ("AND", "OR", "CONTAINS") and not (i + 1 < len(tokens) and tokens[i + 1][0] == "op"):
                words.append(tokens[i][1])  # an unquoted value of several words
                i += 1
            block.append(Clause(value((kind, word)), op, " ".join(words), raw[0] == "quoted"))
        else:
            raise ValueError(f"the filter is malformed at {word!r}")
    blocks.append(tuple(block))
    blocks = [b for b in blocks if b]
    if not blocks and contains is None:
        raise ValueError("the filter has no clause")
    return Filter(tuple(blocks), contains)


def number(value: str) -> float | None:
    try:
        return float(value)
    except ValueError:
        return None


def equal(column: Column, kind: T.DataType, value: str) -> Column:
    """Lenient equality; NULL where the field is missing."""
    n = number(value)
    if isinstance(kind, T.ArrayType):
        return F.exists(column.cast("array<string>"), lambda x: x == value)
    if isinstance(kind, T.BooleanType):
        return column.cast("string") == value.lower()
    if isinstance(kind, T.NumericType):
        return column.cast("double") == n if n is not None else F.lit(False)
    return (column == value) if isinstance(kind, T.StringType) else (column.cast("string") == value)


def clause(c: Clause, fields: Mapping[str, tuple[Column, T.DataType]]) -> Column:
    """A NULL-free predicate; ``fields`` maps names to columns and types. An unknown field counts as missing in every row."""
    known = fields.get(c.field)
    if c.op in ("<", "<=", ">", ">="):
        n = number(c.value)
        if n is None:
            raise ValueError(f"{c.op} needs a number, not {c.value!r}")
        if known is None or not isinstance(known[1], T.NumericType):
            return F.lit(False)
        column = known[0].cast("double")
        return F.coalesce({"<": column < n, "<=": column <= n, ">": column > n, ">=": column >= n}[c.op], F.lit(False))
    same = F.coalesce(equal(known[0], known[1], c.value), F.lit(False)) if known else F.lit(False)
    return same if c.op == "=" else ~same


def predicate(f: Filter | str, fields: Mapping[str, tuple[Column, T.DataType]]) -> Column:
    f = parse(f) if isinstance(f, str) else f
    if not f.blocks:
        return F.lit(True)
    return reduce(Column.__or__, [reduce(Column.__and__, [clause(c, fields) for c in b]) for b in f.blocks])


def fields_of(df: DataFrame) -> dict[str, tuple[Column, T.DataType]]:
    """All columns of ``df`` as filterable fields; of struct columns also their fields, by dotted name."""
    out: dict[str, tuple[Column, T.DataType]] = {}
    for f in df.schema.fields:
        out[f.name] = (F.col(f"`{f.name}`"), f.dataType)
        if isinstance(f.dataType, T.StructType):
            for g in f.dataType.fields:
                out[f"{f.name}.{g.name}"] = (F.col(f"`{f.name}`.`{g.name}`"), g.dataType)
    return out


def where(df: DataFrame, text: str) -> DataFrame:
    """The rows of ``df`` that the filter keeps; plain column predicates, so they're pushed down to the scan."""
    return df.filter(predicate(text, fields_of(df)))


def select_ids(df: DataFrame, text: str, limit: int | None = 10, id_col: str = "id", order: str | None = None) -> DataFrame:
    """Ids of matching rows in id (or ``order``) order, at most ``limit``."""
    rows = where(df, text).orderBy(order or id_col)
    return (rows if limit is None else rows.limit(limit)).select(id_col)


def json_leaf(column: Column, path: str, kind: str) -> Column:
    """A leaf of JSON metadata by dotted path, or NULL if it's missing or of another type."""
    return F.try_variant_get(F.try_parse_json(column), "$." + path, kind)


def live_memory(historical: str = "is_historical", archived: str = "archived") -> Column:
    """The default predicate of memory searches: neither superseded nor archived, missing flags counting as false."""
    return ~F.coalesce(F.col(historical), F.lit(False)) & ~F.coalesce(F.col(archived), F.lit(False))


def in_layers(layers: list[str], column: str = "memory_layer") -> Column:
    return F.coalesce(F.col(column), F.lit("episodic")).isin(layers)
