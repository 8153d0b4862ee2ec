"""Filter trees as columns: each node gives a match that is never NULL and a missing mask."""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass
from dataclasses import field as dc_field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARE = {"EQ": operator.eq, "NE": operator.ne, "GT": operator.gt, "GTE": operator.ge, "LT": operator.lt, "LTE": operator.le}
POLICIES = ("EXCLUDE", "INCLUDE_WITH_FLAG", "IGNORE_FILTER", "REQUIRE_CLARIFICATION")


@dataclass
class Node:
    """op: one of COMPARE, RANGE (value: low, high), IN, NOT_IN, CONTAINS, EXCLUDES, AND, OR (children)."""

    op: str
    name: str = ""
    value: Any = None
    closed: tuple[bool, bool] = (True, True)
    children: list["Node"] = dc_field(default_factory=list)
    policy: str = "EXCLUDE"


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def compiled(node: Node) -> tuple[Column, Column]:
    """(match, missing) of a node."""
    c = F.col(node.name) if node.name else F.lit(None)
    missing = c.isNull()
    if node.op in COMPARE:
        return _true(COMPARE[node.op](c, F.lit(node.value))), missing
    if node.op == "RANGE":
        low = c >= node.value[0] if node.closed[0] else c > node.value[0]
        high = c <= node.value[1] if node.closed[1] else c < node.value[1]
        return _true(low & high), missing
    if node.op == "IN":
        return _true(c.isin(*node.value)), missing
    if node.op == "NOT_IN":
        return ~_true(c.isin(*node.value)), missing
    if node.op == "CONTAINS":
        return _true(F.arrays_overlap(c, F.array(*map(F.lit, node.value)))), missing
    if node.op == "EXCLUDES":
        return ~_true(F.arrays_overlap(c, F.array(*map(F.lit, node.value)))), missing
    parts = [compiled(x) for x in node.children]
    match = functools.reduce(operator.and_ if node.op == "AND" else operator.or_, [m for m, _ in parts])
    lost = functools.reduce(operator.or_, [n for _, n in parts])
    return match, lost if node.op == "AND" else lost & ~match


def applied(df: DataFrame, nodes: list[Node]) -> DataFrame:
    """Rows that pass every filter under its policy; ``filter_flags`` names the filters passed for want of data."""
    keep, flags = F.lit(True), []
    for k, node in enumerate(nodes):
        match, missing = compiled(node)
        if node.policy == "REQUIRE_CLARIFICATION" and df.where(missing).limit(1).count():
            raise ValueError(f"filter {k} on {node.name} needs clarification: values are missing")
        if node.policy in ("INCLUDE_WITH_FLAG", "IGNORE_FILTER"):
            keep = keep & (match | missing)
            if node.policy == "INCLUDE_WITH_FLAG":
                flags.append(F.when(missing, F.lit(f"MISSING_{node.name}")))
        else:
            keep = keep & match
    return df.where(keep).withColumn("filter_flags", F.array_compact(F.array(*flags)) if flags else F.array().cast("array<string>"))


def missing_summary(df: DataFrame, nodes: list[Node]) -> DataFrame:
    """For each filter how many rows it sees, lack its field and survive; a later filter sees the survivors only. One pass."""
    seen, sums = F.lit(True), []
    for k, node in enumerate(nodes):
        match, missing = compiled(node)
        sums += [F.count_if(seen).alias(f"seen_{k}"), F.count_if(seen & missing).alias(f"missing_{k}")]
        seen = seen & match
        sums.append(F.count_if(seen).alias(f"kept_{k}"))
    return df.agg(*sums)


def near_miss(node: Node) -> Column:
    """Within a tenth of the threshold (at least 1.0 counts as its size), or of the range's width; AND wants all others strict."""
    c = F.col(node.name) if node.name else F.lit(None)
    match, _ = compiled(node)
    if node.op in ("GT", "GTE", "LT", "LTE", "EQ"):
        return _true(F.abs(c - F.lit(node.value)) <= 0.1 * max(abs(node.value), 1.0)) & ~match
    if node.op == "RANGE":
        slack = 0.1 * (node.value[1] - node.value[0])
        return _true((c >= node.value[0] - slack) & (c <= node.value[1] + slack)) & ~match
    if node.op == "AND":
        parts = [(compiled(x)[0], near_miss(x)) for x in node.children]
        one = [functools.reduce(operator.and_, [parts[k][1], *[m for i, (m, _) in enumerate(parts) if i != k]]) for k in range(len(parts))]
        return functools.reduce(operator.or_, one)
    if node.op == "OR":
        return functools.reduce(operator.or_, [near_miss(x) for x in node.children]) & ~match
    return F.lit(False)


def layered(df: DataFrame, node: Node) -> DataFrame:
    """df with layer: CORE matches, NEAR nearly does, the rest is CONTROL."""
    return df.withColumn("layer", F.when(compiled(node)[0], "CORE").when(near_miss(node), "NEAR").otherwise("CONTROL"))
