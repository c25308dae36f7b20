"""Predicates on core columns and on attributes.

A predicate on a core column is a column expression.  One on an attribute is a semi or anti
join with the attribute rows that satisfy it, each on its own, so that several may be
combined; a group of alternatives is one semi join with the union of their matches.
``!=`` means that some value differs; ``not`` means that no value fits.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions.dates import resolve_date
from ..functions.text import number_prefix

CORE = ("id", "name", "parent_id", "created", "updated")
DATES = ("created", "updated")
OPERATORS = ("=", "!=", ">", "<", ">=", "<=", "~", "exists", "empty")


@dataclass(frozen=True)
class Where:
    """``field operator value``; ``negate`` turns it round.  Fields: a core column, ``parent.name``, ``parent.tags`` or an attribute."""

    field: str
    op: str = "="
    value: str | int | float | None = None
    negate: bool = False

    def __post_init__(self):
        if self.op not in OPERATORS:
            raise ValueError(f"operator {self.op!r} is none of {OPERATORS}")


@dataclass(frozen=True)
class AnyOf:
    """At least one of the predicates."""

    of: tuple[Where, ...]


def compare(c: Column, op: str, value, attribute: bool) -> Column:
    """The test of one value; attributes compare texts without case and numbers by their leading number."""
    if op == "exists":
        return c.isNotNull()
    if op == "empty":
        return c.isNull() | (c == "")
    if op == "~":
        return F.lower(c).contains(str(value).lower())
    if op in ("=", "!="):
        same = (F.lower(c) == str(value).lower()) | F.lower(c).contains(f">{str(value).lower()}<") if attribute else c == value
        return same if op == "=" else ~same
    left = number_prefix(c) if attribute and isinstance(value, (int, float)) else c
    return {">": left > value, "<": left < value, ">=": left >= value, "<=": left <= value}[op]


def _matches(cat: Catalog, w: Where) -> DataFrame:
    """Ids with an attribute value, or a parent, that satisfies the predicate (negation aside)."""
    if w.field == "parent.tags":
        parents = cat.tags.filter(compare(F.col("tag"), w.op, w.value, False)).select(F.col("id").alias("parent_id")).distinct()
        return cat.nodes.join(parents, "parent_id", "left_semi").select("id")
    if w.field == "parent.name":
        parents = cat.nodes.filter(compare(F.col("name"), w.op, w.value, False)).select(F.col("id").alias("parent_id"))
        return cat.nodes.join(parents, "parent_id", "left_semi").select("id")
    rows = cat.fields.filter(F.col("field") == w.field)
    if w.op == "empty":
        return rows.filter(F.col("value") != "").select("id")
    return rows.filter(compare(F.col("value"), w.op, w.value, True)).select("id")


def apply(cat: Catalog, nodes: DataFrame, where: Sequence[Where | AnyOf], as_of: datetime | None = None) -> DataFrame:
    """Rows of ``nodes`` that satisfy all predicates."""
    for w in where:
        if isinstance(w, AnyOf):
            core = [_core(x, as_of) for x in w.of if x.field in CORE]
            if len(core) == len(w.of):
                nodes = nodes.filter(reduce(Column.__or__, core))
            else:
                # Attributes that fit give their owners at once; the nodes are read again for core columns and absent attributes only.
                direct = [x for x in w.of if x.field not in CORE and x.negate == (x.op == "empty")]
                ids = [_matches(cat, x) for x in direct]
                if core:
                    ids.append(nodes.filter(reduce(Column.__or__, core)).select("id"))
                ids += [apply(cat, nodes.select(*CORE), [x], as_of).select("id") for x in w.of if x.field not in CORE and x not in direct]
                nodes = nodes.join(reduce(DataFrame.unionByName, ids), "id", "left_semi")
        elif w.field in CORE:
            nodes = nodes.filter(_core(w, as_of))
        else:
            wanted = w.negate == (w.op == "empty")
            nodes = nodes.join(_matches(cat, w), "id", "left_semi" if wanted else "left_anti")
    return nodes


def _core(w: Where, as_of: datetime | None) -> Column:
    if w.field in DATES and isinstance(w.value, str):
        if as_of is None:
            raise ValueError("a relative date needs as_of")
        w = replace(w, value=resolve_date(w.value, as_of))
    test = compare(F.col(w.field), w.op, w.value, False)
    return ~test if w.negate else test


#: Operators of structured conditions (fixed values).
STRUCTURED = {"eq": "=", "neq": "!=", "contains": "~", "after": ">", "before": "<", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}


def structured(conditions: dict[str, object]) -> list[Where]:
    """Predicates of ``{field: value or {operator: value}}``: all must hold.

    A text ``~x`` asks for containment (``\\~x`` for the text itself), ``>x``, ``>=x``, ``<x`` and ``<=x`` for a comparison;
    ``exists`` takes true or false.
    """
    out = []
    for field, asked in conditions.items():
        if not isinstance(asked, dict):
            text = str(asked)
            op = next((o for o in ("~", ">=", "<=", ">", "<") if text.startswith(o)), None) if isinstance(asked, str) else None
            out.append(Where(field, op, text[len(op) :].strip()) if op else Where(field, "=", text[1:] if text.startswith("\\~") else asked))
            continue
        for op, value in asked.items():
            if op == "exists":
                out.append(Where(field, "exists", negate=not value))
            elif op in STRUCTURED:
                out.append(Where(field, STRUCTURED[op], value))
            else:
                raise ValueError(f"{op!r} is none of {[*STRUCTURED, 'exists']}")
    return out
