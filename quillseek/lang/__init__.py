"""The expression language: syntax tree, parser and printer."""

from .ast import Exists, Group, Missing, Node, Op, Range, Term
from .parser import QueryParseError, parse

__all__ = ["Exists", "Group", "Missing", "Node", "Op", "QueryParseError", "Range", "Term", "parse"]
