"""Conditions between the syntax tree and a Column.

A condition is two-valued: a row without the field fails `f:x` and passes `NOT f:x`. `emit`
pushes negation down to the leaves, where each knows its own complement in a form that
Parquet scans can use, and folds long lists into balanced trees.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.catalog import FieldRef, Relation


class Condition:
    pass


@dataclass
class Const(Condition):
    value: bool


@dataclass
class Leaf(Condition):
    """A test of one field. `yes` and `no` take its column; without `no` the complement is coalesced.

    value: for equalities, so that several of one field become one list.
    """

    ref: FieldRef
    yes: Callable[[Column], Column]
    no: Callable[[Column], Column] | None = None
    value: object = None


@dataclass
class Ready(Condition):
    """A column that a caller has set."""

    column: Column


@dataclass
class Not(Condition):
    inner: Condition


@dataclass
class Many(Condition):
    parts: list[Condition]
    every: bool


@dataclass
class InArray(Condition):
    """Some element of the array at `path` meets the inner condition. A primitive array's element is the value itself."""

    path: str
    ref: FieldRef
    depth: int
    inner: Condition


@dataclass
class Related(Condition):
    """Some related row meets the inner condition."""

    relation: Relation
    inner: Condition


def many(parts: list[Condition], every: bool) -> Condition:
    flat: list[Condition] = []
    for p in parts:
        flat.extend(p.parts if isinstance(p, Many) and p.every == every else [p])
    flat = [p for p in flat if not (isinstance(p, Const) and p.value == every)]
    if any(isinstance(p, Const) for p in flat):
        return Const(not every)
    if not flat:
        return Const(every)
    return flat[0] if len(flat) == 1 else Many(flat, every)


def nested(ref: FieldRef, leaf: Condition, inside: tuple[str, ...] = (), at: int = 0) -> Condition:
    """The leaf within the arrays and relations on its field's way, but for the arrays it is inside of already."""
    out = leaf
    for n in reversed(ref.arrays):
        path = ".".join(ref.path[:n])
        if path not in inside:
            out = InArray(path, ref, n, out)
    for r in reversed(ref.relations[at:]):
        out = Related(r, out)
    return out


def correlated(condition: Condition) -> Condition:
    """Tests of one array in one chain meet on one element; a negated test of a deeper array goes into its parent's element."""
    if isinstance(condition, Not):
        return Not(correlated(condition.inner))
    if isinstance(condition, InArray):
        return InArray(condition.path, condition.ref, condition.depth, correlated(condition.inner))
    if not isinstance(condition, Many):
        return condition
    parts: list[Condition] = []
    by_path: dict[str, InArray] = {}
    for p in condition.parts:
        if isinstance(p, InArray):
            if p.path in by_path:
                first = by_path[p.path]
                first.inner = many([first.inner, p.inner], condition.every)
                continue
            p = InArray(p.path, p.ref, p.depth, p.inner)
            by_path[p.path] = p
        parts.append(p)
    if condition.every:
        kept = []
        for p in parts:
            inner = p.inner if isinstance(p, Not) else None
            if isinstance(inner, InArray) and isinstance(inner.inner, InArray) and inner.path in by_path:
                host = by_path[inner.path]
                host.inner = many([host.inner, Not(inner.inner)], True)
            else:
                kept.append(p)
        parts = kept
    return many([correlated(p) for p in parts], condition.every)


def _balanced(columns: list[Column], join: Callable[[Column, Column], Column]) -> Column:
    while len(columns) > 1:
        columns = [join(*columns[i : i + 2]) if i + 1 < len(columns) else columns[i] for i in range(0, len(columns), 2)]
    return columns[0]


def _lists(parts: list[Condition], every: bool) -> list[Condition]:
    """Under OR, equalities of one field as one list."""
    if every:
        return parts
    by_field: dict[str, list[Leaf]] = {}
    for p in parts:
        if isinstance(p, Leaf) and p.value is not None:
            by_field.setdefault(p.ref.name, []).append(p)
    out, done = [], set()
    for p in parts:
        group = by_field.get(p.ref.name, []) if isinstance(p, Leaf) and p.value is not None else []
        if len(group) < 2:
            out.append(p)
        elif p.ref.name not in done:
            done.add(p.ref.name)
            values = list(dict.fromkeys(g.value for g in group))
            out.append(Leaf(p.ref, lambda c, v=values: c.isin(v), lambda c, v=values: ~c.isin(v) | c.isNull()))
    return out


def emit(condition: Condition, elements: dict[str, Column] | None = None, negate: bool = False) -> Column:
    if isinstance(condition, Const):
        return F.lit(condition.value != negate)
    if isinstance(condition, Not):
        return emit(condition.inner, elements, not negate)
    if isinstance(condition, Many):
        every = condition.every != negate
        parts = [emit(p, elements, negate) for p in _lists(condition.parts, condition.every)]
        return _balanced(parts, (lambda a, b: a & b) if every else (lambda a, b: a | b))
    if isinstance(condition, Leaf):
        column = condition.ref.column(elements)
        if not negate:
            return condition.yes(column)
        return condition.no(column) if condition.no else ~F.coalesce(condition.yes(column), F.lit(False))
    if isinstance(condition, Ready):
        return ~F.coalesce(condition.column, F.lit(False)) if negate else condition.column
    if isinstance(condition, InArray):
        shorter = FieldRef(condition.ref.path[: condition.depth], tuple(n for n in condition.ref.arrays if n < condition.depth), None)
        array = shorter.column(elements)
        found = F.exists(array, lambda e: F.coalesce(emit(condition.inner, {**(elements or {}), condition.path: e}), F.lit(False)))
        return ~F.coalesce(found, F.lit(False)) if negate else F.coalesce(found, F.lit(False))
    if isinstance(condition, Related):
        found = related(condition.relation, emit(condition.inner, None))
        return ~found if negate else found
    raise TypeError(condition)


def related(relation: Relation, test: Column) -> Column:
    """Whether some related row passes: an EXISTS that Spark plans as a semi, anti or existence join."""
    rows = relation.child.where(test)
    outer = F.col(f"`{relation.parent_key}`").outer()
    if relation.bridge is None:
        return rows.where(F.col(f"`{relation.child_key}`") == outer).exists()
    bridge, ours, theirs = relation.bridge
    keys = rows.select(F.col(f"`{relation.child_key}`").alias("__bridged"))
    met = bridge.select(F.col(f"`{ours}`").alias("__ours"), F.col(f"`{theirs}`").alias("__theirs")).join(keys, F.col("__theirs") == F.col("__bridged"), "left_semi")
    return met.where(F.col("__ours") == outer).exists()
