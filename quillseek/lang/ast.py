"""Syntax tree of filter, aggregation and sort expressions.

A group holds at most two operands; a chain `a b c` leans to the right, and a group in the
right place without parentheses or field is just the rest of the chain. `str(node)` gives the
expression back.
"""

from __future__ import annotations

import copy
import enum
import re
from collections.abc import Iterator
from dataclasses import dataclass
from dataclasses import field as dc_field
from typing import Any

ESCAPED = re.compile(r"\\(.)", re.S)


class Op(enum.Enum):
    DEFAULT = " "
    AND = " AND "
    OR = " OR "


def unescape(text: str | None) -> str | None:
    """Without the backslashes that escape characters; one at the very end stays."""
    return None if text is None else ESCAPED.sub(r"\1", text)


@dataclass
class Node:
    negated: bool | None = None
    prefix: str | None = None
    field: str | None = None
    #: What rewrites and callers attach: `column` (a ready predicate), `sort`, `agg`, `original_field`, ...
    data: dict[str, Any] = dc_field(default_factory=dict, compare=False)

    @property
    def excluded(self) -> bool:
        """`NOT` and `-` both exclude; together they still exclude once."""
        return bool(self.negated) or self.prefix in ("-", "!")

    @property
    def required(self) -> bool:
        return self.prefix == "+"

    @property
    def name(self) -> str | None:
        return unescape(self.field)

    def children(self) -> list[Node]:
        return []

    def clone(self) -> Node:
        out = copy.copy(self)
        out.data = dict(self.data)
        return out

    def head(self) -> str:
        return ("NOT " if self.negated else "") + (self.prefix or "")


def _tail(node: Term | Range | Group) -> str:
    return ("" if node.proximity is None else f"~{node.proximity}") + ("" if node.boost is None else f"^{node.boost}")


@dataclass
class Term(Node):
    term: str = ""
    quoted: bool = False
    regex: bool = False
    proximity: str | None = None
    boost: str | None = None

    @property
    def text(self) -> str:
        return unescape(self.term) or ""

    def __str__(self) -> str:
        mark = '"' if self.quoted else "/" if self.regex else ""
        name = f"{self.field}:" if self.field else ""
        return f"{self.head()}{name}{mark}{self.term or ''}{mark}{_tail(self)}"


@dataclass
class Range(Node):
    low: str | None = None
    high: str | None = None
    low_quoted: bool = False
    high_quoted: bool = False
    low_inclusive: bool = False
    high_inclusive: bool = False
    #: `>`, `>=`, `<` or `<=` of a one-sided range.
    sign: str | None = None
    delimiter: str | None = None
    proximity: str | None = None
    boost: str | None = None

    @staticmethod
    def bound(text: str | None) -> str | None:
        """The bound's value; None where the range is open."""
        value = unescape(text)
        return None if value is None or value.strip() in ("", "*") else value

    def __str__(self) -> str:
        def shown(text: str | None, quoted: bool) -> str:
            return f'"{text}"' if quoted else text or ""

        name = f"{self.field}:" if self.field else ""
        if self.sign:
            body = self.sign + (shown(self.low, self.low_quoted) if self.low is not None else shown(self.high, self.high_quoted))
        else:
            sep = self.delimiter or " TO "
            body = ("[" if self.low_inclusive else "{") + shown(self.low, self.low_quoted) + sep + shown(self.high, self.high_quoted) + ("]" if self.high_inclusive else "}")
        return f"{self.head()}{name}{body}{_tail(self)}"


@dataclass
class Exists(Node):
    def __str__(self) -> str:
        return f"{self.head()}_exists_:{self.field}"


@dataclass
class Missing(Node):
    def __str__(self) -> str:
        return f"{self.head()}_missing_:{self.field}"


@dataclass
class Group(Node):
    left: Node | None = None
    right: Node | None = None
    op: Op = Op.DEFAULT
    parens: bool = False
    proximity: str | None = None
    boost: str | None = None

    def children(self) -> list[Node]:
        return [n for n in (self.left, self.right) if n is not None]

    @property
    def is_chain(self) -> bool:
        """Whether this is only the rest of a chain, with nothing of its own."""
        return not (self.parens or self.field or self.excluded or self.prefix)

    def clone(self) -> Group:
        """A deep copy; long chains are copied without recursion."""
        head = last = None
        node: Node | None = self
        while isinstance(node, Group):
            new = copy.copy(node)
            new.data = dict(node.data)
            new.left = node.left.clone() if node.left else None
            if last is None:
                head = new
            else:
                last.right = new
            last, node = new, node.right
        last.right = node.clone() if node else None
        return head

    def shown(self, default: Op = Op.DEFAULT) -> str:
        """The expression; `default` is written out where no operator stands."""
        parts: list[str] = []
        closing: list[str] = []
        node: Node | None = self
        while isinstance(node, Group):
            if node.left is None and node.right is None:
                break
            parts.append(node.head() + (f"{node.field}:" if node.field else "") + ("(" if node.parens else ""))
            closing.append((")" if node.parens else "") + _tail(node))
            if node.left is not None:
                parts.append(node.left.shown(default) if isinstance(node.left, Group) else str(node.left))
            if node.left is not None and node.right is not None:
                parts.append((node.op if node.op is not Op.DEFAULT else default).value)
            node = node.right
        if node is not None and not isinstance(node, Group):
            parts.append(str(node))
        return "".join(parts) + "".join(reversed(closing))

    def __str__(self) -> str:
        return self.shown()


def walk(node: Node | None) -> Iterator[Node]:
    """All nodes, parents first, from left to right."""
    stack = [node] if node is not None else []
    while stack:
        n = stack.pop()
        yield n
        stack.extend(reversed(n.children()))


def dump(node: Node, depth: int = 0) -> str:
    """An indented picture of the tree."""
    own = {k: v for k, v in vars(node).items() if k not in ("left", "right", "data") and v not in (None, False) and v is not Op.DEFAULT}
    shown = " ".join(f"{k}={v.name if isinstance(v, Op) else v!r}" for k, v in own.items())
    lines = ["  " * depth + type(node).__name__ + (f" {shown}" if shown else "")]
    return "\n".join(lines + [dump(c, depth + 1) for c in node.children()])
