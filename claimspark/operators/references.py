"""Deletes over a whole graph of references: children of what goes go as well, or lose their reference."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from graphlib import CycleError, TopologicalSorter
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Reference(NamedTuple):
    """child.column refers to parent.key; when the parent's row goes, the child's row goes (`cascade`) or its column becomes null."""

    child: str
    column: str
    parent: str
    key: str = "id"
    cascade: bool = True


def in_order(references: list[Reference]) -> list[str]:
    """Tables, parents before children, by the references that cascade. A cycle of these is an error; one through a reference that becomes null is none."""
    graph = TopologicalSorter({r.child: set() for r in references} | {r.parent: set() for r in references})
    for r in references:
        if r.cascade:
            graph.add(r.child, r.parent)
    try:
        return list(graph.static_order())
    except CycleError as e:
        raise ValueError(f"deletes would go round in a circle: {' -> '.join(e.args[1])}") from e


def going(tables: dict[str, DataFrame], references: list[Reference], doomed: dict[str, DataFrame], keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """Per table the keys that its children refer to, of the rows that go with those of `doomed` (table to rows with its keys).

    One walk from parents to children. Only keys are carried; `keep` may write them, so that each is made once.
    """
    keys: dict[str, set[str]] = {}
    for r in references:
        keys.setdefault(r.parent, set()).add(r.key)
    gone: dict[str, DataFrame] = {}
    for name in in_order(references):
        if not (wanted := sorted(keys.get(name, ()))):
            continue
        rows = [doomed[name].select(*wanted)] if name in doomed else []
        rows += [tables[name].join(gone[r.parent].select(F.col(r.key).alias(r.column)).distinct(), r.column, "left_semi").select(*wanted) for r in references if r.child == name and r.cascade and r.parent in gone]
        if rows:
            gone[name] = keep(reduce(DataFrame.unionByName, rows).distinct())
    return gone


def deleted(tables: dict[str, DataFrame], references: list[Reference], doomed: dict[str, DataFrame], keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """The tables after the rows of `doomed` were deleted, with all that goes with them and references to it that become null.

    A null reference refers to nothing. References of a table to itself may become null, but not cascade. Each table is read once for what goes and once for what stays.
    """
    gone, out = going(tables, references, doomed, keep), {}
    for name, rows in tables.items():
        left = rows
        if name in doomed:
            key = next((r.key for r in references if r.parent == name), None) or doomed[name].columns[0]
            left = left.join(doomed[name].select(key).distinct(), key, "left_anti")
        for r in references:
            if r.child != name or r.parent not in gone:
                continue
            hit = gone[r.parent].select(F.col(r.key).alias(r.column)).distinct()
            if r.cascade:
                left = left.join(hit, r.column, "left_anti")
            else:
                marked = left.join(hit.withColumn("_gone", F.lit(True)), r.column, "left")
                left = marked.withColumn(r.column, F.when(F.col("_gone").isNull(), F.col(r.column)))
        out[name] = left.select(rows.columns)
    return out
