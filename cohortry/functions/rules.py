"""Ordered rule tables, compiled to one CASE expression: as a Spark column or as SQL text. The first match wins.

A condition is a tuple: ("has", words...) any of the words stands in the text; ("starts", words...); ("is", values...);
("like", patterns...) any pattern is found; ("not", condition); ("and", conditions...); ("or", conditions...).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Condition = tuple


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def condition_column(rule: Condition, text: Column) -> Column:
    kind, *rest = rule
    if kind in ("and", "or"):
        return reduce(lambda a, b: a & b if kind == "and" else a | b, [condition_column(r, text) for r in rest])
    if kind == "not":
        return ~condition_column(rest[0], text)
    if kind == "is":
        return text.isin(*rest)
    test = {"has": lambda w: F.contains(text, F.lit(w)), "starts": lambda w: F.startswith(text, F.lit(w)), "like": lambda w: text.rlike(w)}[kind]
    return reduce(lambda a, b: a | b, map(test, rest))


def condition_sql(rule: Condition, text: str) -> str:
    kind, *rest = rule
    if kind in ("and", "or"):
        return "(" + f" {kind.upper()} ".join(condition_sql(r, text) for r in rest) + ")"
    if kind == "not":
        return f"(NOT {condition_sql(rest[0], text)})"
    if kind == "is":
        return f"({text} IN ({', '.join(map(quoted, rest))}))"
    test = {"has": "contains({0}, {1})", "starts": "starts_with({0}, {1})", "like": "regexp_matches({0}, {1})"}[kind]
    return "(" + " OR ".join(test.format(text, quoted(w)) for w in rest) + ")"


@dataclass(frozen=True)
class RuleTable:
    """``rules``: (condition, value) pairs in order; a value of None is NULL. ``otherwise`` is the last resort."""

    rules: tuple[tuple[Condition, str | int | None], ...]
    otherwise: str | int | None = None

    def column(self, text: Column) -> Column:
        first, *more = self.rules
        out = F.when(condition_column(first[0], text), F.lit(first[1]))
        for condition, value in more:
            out = out.when(condition_column(condition, text), F.lit(value))
        return out.otherwise(F.lit(self.otherwise))

    def sql(self, text: str) -> str:
        value = lambda v: "NULL" if v is None else quoted(v) if isinstance(v, str) else str(v)
        return "CASE " + " ".join(f"WHEN {condition_sql(c, text)} THEN {value(v)}" for c, v in self.rules) + f" ELSE {value(self.otherwise)} END"


@dataclass(frozen=True)
class Taxonomy:
    """Rules with several outputs: (condition, outputs) in order, one output per field name."""

    fields: tuple[str, ...]
    rules: tuple[tuple[Condition, tuple], ...]
    otherwise: tuple

    def table(self, field: str) -> RuleTable:
        k = self.fields.index(field)
        return RuleTable(tuple((c, out[k]) for c, out in self.rules), self.otherwise[k])

    def column(self, text: Column) -> Column:
        """All outputs as one struct; the rules are tested once."""
        made = lambda out: F.struct(*[F.lit(v).alias(f) for f, v in zip(self.fields, out)])
        first, *more = self.rules
        case = F.when(condition_column(first[0], text), made(first[1]))
        for condition, out in more:
            case = case.when(condition_column(condition, text), made(out))
        return case.otherwise(made(self.otherwise))
