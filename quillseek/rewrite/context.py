"""What one compilation carries along, and how trees are mapped."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from dataclasses import field as dc_field
from typing import Any

from ..lang.ast import Group, Node, Op
from .validate import ValidationOptions, ValidationResult

FieldResolver = Callable[[str], str | None]


@dataclass
class Context:
    kind: str = "query"
    default_operator: Op = Op.AND
    default_fields: tuple[str, ...] = ()
    field_resolver: FieldResolver | None = None
    includes: dict[str, str] | Callable[[str], str | None] | None = None
    skip_include: Callable[[Node, Context], bool] | None = None
    include_name: str = "include"
    options: ValidationOptions = dc_field(default_factory=ValidationOptions)
    result: ValidationResult = dc_field(default_factory=ValidationResult)
    alternate_inverted: str | None = None
    bag: dict[str, Any] = dc_field(default_factory=dict)

    def get_string(self, key: str, default: str | None = None) -> str | None:
        return str(self.bag[key]) if self.bag.get(key) is not None else default

    def get_boolean(self, key: str, default: bool = False) -> bool:
        value = self.bag.get(key, default)
        return value.strip().lower() == "true" if isinstance(value, str) else bool(value)

    def get_date(self, key: str, default: dt.datetime | None = None) -> dt.datetime | None:
        value = self.bag.get(key, default)
        return dt.datetime.fromisoformat(value) if isinstance(value, str) else value

    def get_list(self, key: str) -> list:
        value = self.bag.get(key)
        return [] if value is None else list(value) if isinstance(value, list | tuple | set) else [value]


def map_nodes(node: Node | None, change: Callable[[Node], Node | None]) -> Node | None:
    """The tree with every node changed, children first; None removes a node, and what removal leaves empty."""
    spine: list[Group] = []
    rest = node
    while isinstance(rest, Group):
        spine.append(rest)
        rest = rest.right
    out = change(rest) if rest is not None else None
    for g in reversed(spine):
        had = g.left is not None or g.right is not None
        g.left, g.right = map_nodes(g.left, change) if g.left is not None else None, out
        if had and g.left is None and g.right is None:
            out = None
            continue
        if g.left is None and g.is_chain:
            out = g.right
            continue
        out = change(g)
    return out
