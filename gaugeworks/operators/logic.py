"""Decision rules as columns: three-valued rule trees, policies with caps, constraint ranking, exact percentages, business days."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def atom(op: str, field: Column, value) -> Column:
    """One comparison; a missing field is unknown (null)."""
    if op == "range":
        return (field >= value) & (field <= value + 10)
    if op == "flag":
        return field
    return {"lt": field < value, "le": field <= value, "gt": field > value, "ge": field >= value, "eq": field == value, "match": field == value}[op]


def rule(tree, atoms: Mapping[str, Column]) -> Column:
    """A tree of nested tuples (op, child, ...): and, or, not, unless, if; leaves name atoms. SQL's three-valued logic is the rule's own.

    ``if`` with an unknown condition has a value when both branches have the same one.
    """
    if isinstance(tree, str):
        return atoms[tree]
    op, *parts = tree
    x = [rule(p, atoms) for p in parts]
    if op == "and" or op == "or":
        out = x[0]
        for y in x[1:]:
            out = (out & y) if op == "and" else (out | y)
        return out
    if op == "not":
        return ~x[0]
    if op == "unless":
        return x[0] & ~x[1]
    if op == "if":
        return F.when(x[0], x[1]).when(~x[0], x[2]).when(x[1].eqNullSafe(x[2]), x[1])
    raise ValueError(f"unknown operator {op}")


def shape(tree) -> str:
    """The structure without names of leaves; operands of and/or in order of their own shapes."""
    if isinstance(tree, str):
        return "_"
    op, *parts = tree
    inner = [shape(p) for p in parts]
    return f"{op}({','.join(sorted(inner) if op in ('and', 'or') else inner)})"


def canonical(tree) -> str:
    """A structure key: operands of and/or stand by shape, and leaves are numbered as they first occur, so neither order nor names count."""
    numbers: dict[str, int] = {}

    def text(t) -> str:
        if isinstance(t, str):
            return str(numbers.setdefault(t, len(numbers)))
        op, *parts = t
        return f"{op}({','.join(map(text, ordered(op, parts)))})"

    def ordered(op, parts):
        return sorted(parts, key=shape) if op in ("and", "or") else parts

    return text(tree)


def push_negation(tree, negated: bool = False):
    """The tree with negations at its leaves, and before a conditional, which keeps its own: not(if a then b else c)."""
    if isinstance(tree, str):
        return ("not", tree) if negated else tree
    op, *parts = tree
    if op == "not":
        return push_negation(parts[0], not negated)
    if op == "unless":
        return push_negation(("and", parts[0], ("not", parts[1])), negated)
    if op == "if":
        kept = ("if", *map(push_negation, parts))
        return ("not", kept) if negated else kept
    return ({"and": "or", "or": "and"}[op] if negated else op, *(push_negation(p, negated) for p in parts))


def reasons(**checks: Column) -> Column:
    """The names of the checks that hold, in order; unknown ones do not."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]))


def payout(amount_cents: Column, fee_cents: Column, cap_cents: Column, percent: Column) -> Column:
    """Integer cents: percent of the amount rounded half up, capped, less the fee, not below zero."""
    return F.greatest(F.lit(0), F.least(F.floor((amount_cents * percent + 50) / 100), cap_cents) - fee_cents)


def per_mille(p: Column) -> Column:
    return F.floor(p * 1000 + 0.5)


def posterior(prior: Column, hit: Column, false_alarm: Column) -> Column:
    return prior * hit / (prior * hit + (1 - prior) * false_alarm)


def business_day_after(start: Column, days: int, holidays: Sequence[str] = ()) -> Column:
    """The days-th working day (Monday to Friday, no holiday) after start."""
    off = F.array(*map(F.lit, holidays)).cast("array<string>")
    ahead = F.sequence(F.date_add(start, 1), F.date_add(start, 2 * days + 7 + len(holidays)))
    return F.get(F.filter(ahead, lambda d: (F.weekday(d) < 5) & ~F.array_contains(off, d.cast("string"))), F.lit(days - 1))


def whole_months(a: Column, b: Column) -> Column:
    """Whole months from a to b."""
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a) - (F.dayofmonth(b) < F.dayofmonth(a)).cast("int")


def best_option(options: DataFrame, keys: Sequence[str], meets: Column, rank: Sequence[Column]) -> DataFrame:
    """keys, best: the first qualifying option; 'none_qualifies' where none does, a tie on all of rank is null."""
    w = W.partitionBy(*keys)
    ranked = options.withColumn("_ok", F.coalesce(meets, F.lit(False))).withColumn("_r", F.rank().over(w.orderBy(F.desc("_ok"), *rank)))
    top = ranked.where("_r = 1").groupBy(*keys).agg(F.count("*").alias("n"), F.max("_ok").alias("ok"), F.min("option").alias("option"))
    return top.select(*keys, F.when(~F.col("ok"), "none_qualifies").when(F.col("n") == 1, F.col("option")).alias("best"))
