"""A base for callers' own passes over a tree that give a result of their own."""

from __future__ import annotations

from typing import Generic, TypeVar

from ..lang import Exists, Group, Missing, Node, Range, Term

R = TypeVar("R")


class Visitor(Generic[R]):
    """Visits every node, groups before what they hold, and gives `result` at the end.

    Subclasses override what they need: `group`, `term`, `range`, `exists`, `missing`, each
    with (node, context), or `leaf` for all but groups. A group that returns False is not entered.
    An instance is a rewrite too: in a chain it leaves the tree as it is.
    """

    result: R

    def group(self, node: Group, context: object) -> bool | None:
        return None

    def leaf(self, node: Node, context: object) -> None:
        return None

    def term(self, node: Term, context: object) -> None:
        self.leaf(node, context)

    def range(self, node: Range, context: object) -> None:
        self.leaf(node, context)

    def exists(self, node: Exists, context: object) -> None:
        self.leaf(node, context)

    def missing(self, node: Missing, context: object) -> None:
        self.leaf(node, context)

    def visit(self, node: Node | None, context: object = None) -> R:
        stack = [] if node is None else [node]
        while stack:
            n = stack.pop()
            if isinstance(n, Group):
                if self.group(n, context) is not False:
                    stack.extend(reversed(n.children()))
                continue
            for kind, meet in ((Term, self.term), (Range, self.range), (Exists, self.exists), (Missing, self.missing)):
                if isinstance(n, kind):
                    meet(n, context)
                    break
        return self.result

    def __call__(self, node: Node, context: object) -> Node:
        self.visit(node, context)
        return node
