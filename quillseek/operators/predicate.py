"""Filter expressions to conditions.

A chain `a OP b OP c` has no precedence: the right operand of an operator is all the rest.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import datemath, geo, text
from ..lang import Exists, Group, Missing, Node, Op, Range, Term
from ..sources.catalog import DATES, FieldCatalog, FieldRef
from .conditions import Condition, Const, InArray, Leaf, Many, Not, Ready, Related, correlated, emit, many, nested


class Unsupported(ValueError):
    pass


_whole = re.compile(r"[+-]?[0-9]+")
_number = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")
_endless = re.compile(r"[+-]?(nan|inf(inity)?)", re.I)


def typed(value: str, kind: T.DataType | None):
    """A literal of the field's type; None if the text is none. Numbers are written with ASCII digits."""
    digits = value.strip()
    if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType) and not _whole.fullmatch(digits):
        return None
    if isinstance(kind, T.FloatType | T.DoubleType | T.DecimalType) and not _number.fullmatch(digits) and not (_endless.fullmatch(digits) and not isinstance(kind, T.DecimalType)):
        return None
    try:
        if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
            n = int(digits)
            bits = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}[type(kind)]
            return n if -(1 << bits - 1) <= n < 1 << bits - 1 else None
        if isinstance(kind, T.FloatType | T.DoubleType):
            return float(digits)
        if isinstance(kind, T.DecimalType):
            return decimal.Decimal(digits)
    except (ValueError, decimal.InvalidOperation):
        return None
    if isinstance(kind, T.BooleanType):
        return {"true": True, "false": False}.get(value.strip().lower())
    return value


def instant(moment: dt.datetime, kind: T.DataType) -> Column:
    """A literal of naive UTC as the field's date type."""
    if isinstance(kind, T.TimestampNTZType):
        return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(moment.isoformat(sep=" ") + "+00:00").cast("timestamp")


class PredicateCompiler:
    """Compiles one expression against a catalogue. `config` is an EngineConfig."""

    def __init__(self, config, catalog: FieldCatalog, context):
        self.config, self.catalog, self.context = config, catalog, context
        self.relational = config.mode == "relational"

    def column(self, node: Node | None) -> Column:
        return emit(self.condition(node))

    def condition(self, node: Node | None) -> Condition:
        condition = self._node(node, None, ())
        return condition if self.relational else correlated(condition)

    # groups

    def _op(self, group: Group) -> Op:
        return self.config.default_operator if group.op is Op.DEFAULT else group.op

    def _operands(self, group: Group, op: Op) -> list[Node]:
        """Operands of a chain of one operator; a rest of another operator is one operand."""
        out: list[Node] = []
        node: Node | None = group
        first = True
        while isinstance(node, Group) and (first or (node.is_chain and self._op(node) is op and not node.data.get("column"))):
            first = False
            if node.left is not None:
                out.append(node.left)
            if node.left is not None and node.right is None:
                return out
            node = node.right
        return [*out, node] if node is not None else out

    def _requires(self, node: Node) -> bool:
        if node.required:
            return True
        return isinstance(node, Group) and node.is_chain and any(self._requires(c) for c in self._operands(node, self._op(node)))

    def _node(self, node: Node | None, scope: str | None, inside: tuple[str, ...]) -> Condition:
        if node is None:
            return Const(True)
        if (ready := node.data.get("column")) is not None:
            out: Condition = Ready(ready)
        elif isinstance(node, Group):
            out = self._group(node, scope, inside)
        else:
            out = self._leaf(node, scope, inside)
        return Not(out) if node.excluded and not (isinstance(node, Group) and node.left is None and node.right is None) else out

    def _group(self, group: Group, scope: str | None, inside: tuple[str, ...]) -> Condition:
        array = None
        if group.field:
            path = self.catalog.nested_path(self._resolve_name(group.name))
            if path and not self.relational and path not in inside:
                array = path
            else:
                scope = group.name
        elif group.parens and self.config.strict_scope and not group.data.get("root"):
            scope = None
        deeper = (*inside, array) if array else inside
        op = self._op(group)
        operands = self._operands(group, op)
        every = op is not Op.OR
        if group.required and not every and group.parens and self.config.required_mode == "search":
            every = True
        elif not every and self.config.required_mode == "relational" and any(self._requires(o) for o in operands):
            operands, every = [o for o in operands if self._requires(o) or o.excluded], True
        out = many([self._node(o, scope, deeper) for o in operands], every) if operands else Const(True)
        if array:
            ref = FieldRef(tuple(array.split(".")) + ("",), tuple(n for n in range(1, array.count(".") + 2) if self.catalog.nested_path(".".join(array.split(".")[:n]))), None)
            out = correlated(out)
            for n in reversed(ref.arrays):
                p = ".".join(ref.path[:n])
                if p in inside:
                    continue
                if p == array:
                    out = self._filtered(p, out)
                out = InArray(p, ref, n, out)
        return out

    def _filtered(self, path: str, condition: Condition) -> Condition:
        """The caller's own filter of an array's elements, within the element."""
        if not self.config.nested_filter:
            return condition
        extra = self.config.nested_filter(path)
        if extra is None:
            return condition
        if isinstance(extra, str):
            from ..lang import parse

            inside = tuple(".".join(path.split(".")[:n]) for n in range(1, path.count(".") + 2))
            return many([condition, self._node(parse(extra), None, inside)], True)
        return many([condition, Ready(extra)], True)

    # leaves

    def _resolve_name(self, name: str | None) -> str | None:
        return name

    def _leaf(self, node: Node, scope: str | None, inside: tuple[str, ...]) -> Condition:
        name = node.name or scope
        if isinstance(node, Exists | Missing):
            return self._presence(node, inside)
        if name:
            return self._on_field(node, name, inside, default=False)
        if isinstance(node, Range):
            self.context.result.warnings.append(f"{node} has no field")
            return Const(True)
        fields = self.config.default_fields or tuple(self.catalog.text_fields())
        parts = [p for f in fields if (p := self._on_field(node, f, inside, default=True)) is not None]
        return many(parts, False)

    def _wrap(self, ref: FieldRef, leaf: Condition, inside: tuple[str, ...]) -> Condition:
        if self.config.nested_filter and ref.arrays:
            deepest = ref.nested_paths[-1]
            if deepest not in inside and self.catalog.nested_path(deepest):
                leaf = self._filtered(deepest, leaf)
        return nested(ref, leaf, inside)

    def _presence(self, node: Exists | Missing, inside: tuple[str, ...]) -> Condition:
        has = isinstance(node, Exists)
        path = self.catalog.nested_path(node.name)
        if path and path not in inside:
            ref = FieldRef(tuple(path.split(".")), tuple(n for n in range(1, path.count(".") + 1) if self.catalog.nested_path(".".join(path.split(".")[:n]))), None)
            some = Leaf(ref, lambda c: F.coalesce(F.size(c) > 0, F.lit(False)))
            return nested(ref, some if has else Not(some), inside)
        ref = self.catalog.resolve(node.name)
        if ref is None:
            self.context.result.unresolved_fields.add(node.name)
            return Const(not has)
        if ref.relations and not ref.path:
            some = Related(ref.relations[0], Const(True))
            return some if has else Not(some)
        present = Leaf(ref, lambda c: c.isNotNull(), lambda c: c.isNull())
        if self.relational or ref.relations or (ref.arrays and not self.catalog.nested_path(ref.nested_paths[-1])):
            found = nested(ref, present, inside)
            return found if has else Not(found)
        return self._wrap(ref, present if has else Not(present), inside)

    def _on_field(self, node: Term | Range, name: str, inside: tuple[str, ...], default: bool) -> Condition | None:
        ref = self.catalog.resolve(name)
        if ref is None:
            self.context.result.unresolved_fields.add(name)
            return Const(False)
        if ref.relations and not ref.path:
            return Const(False)
        if isinstance(node, Range):
            return self._wrap(ref, self._range(node, ref), inside)
        leaf = self._term(node, ref, default)
        return None if leaf is None else self._wrap(ref, leaf, inside)

    def _equals(self, ref: FieldRef, value: str) -> Condition:
        if isinstance(ref.dtype, DATES):
            return self._date_span(ref, value, value, True, True, None)
        literal = typed(value, ref.dtype)
        if literal is None:
            return Const(False)
        return Leaf(ref, lambda c: c == F.lit(literal), lambda c: ~c.eqNullSafe(F.lit(literal)), value=literal)

    def _text(self, ref: FieldRef, yes: Callable[[Column], Column]) -> Leaf:
        return Leaf(ref, yes, lambda c: ~yes(c) | c.isNull())

    def _term(self, node: Term, ref: FieldRef, default: bool) -> Condition | None:
        if ref.geo and not node.regex:
            return self._geo_distance(node, ref)
        if self.relational:
            return self._relational_term(node, ref, default)
        extensions = self.config.extensions
        value = node.text
        is_text = isinstance(ref.dtype, T.StringType)
        if "dots" in extensions and not node.quoted and ".." in node.term.strip("."):
            low, _, high = node.term.partition("..")
            return self._range(Range(low=low, high=high, low_inclusive=True, high_inclusive=True), ref)
        if node.regex and "regex" in extensions and is_text:
            return self._text(ref, lambda c: c.rlike(f"^(?:{node.term})$".replace("\\/", "/")))
        if not node.quoted and node.term == "*":
            return Leaf(ref, lambda c: c.isNotNull(), lambda c: c.isNull())
        ends = not node.quoted and node.term.endswith("*") and not node.term.endswith("\\*")
        if not node.quoted and "wildcards" in extensions and is_text and any(w in node.term.replace("\\*", "").replace("\\?", "") for w in "*?"):
            pattern = text.glob_pattern(node.term)
            if ref.analyzed:
                return self._text(ref, lambda c: F.exists(text.tokens(c), lambda t: t.rlike(pattern.lower())))
            return self._text(ref, lambda c: c.rlike(pattern))
        if "fuzzy" in extensions and node.proximity is not None and is_text and not node.quoted:
            most = int(node.proximity or 2)
            near = lambda c: F.levenshtein(c, F.lit(value), most) >= 0
            return self._text(ref, (lambda c: F.exists(text.tokens(c), lambda t: F.levenshtein(t, F.lit(value.lower()), most) >= 0)) if ref.analyzed else near)
        if ref.analyzed:
            if ends:
                return self._text(ref, lambda c: text.token_prefix(c, value[:-1]))
            return self._text(ref, (lambda c: text.phrase(c, value)) if node.quoted else (lambda c: text.match_any(c, value)))
        if ends and is_text:
            return self._text(ref, lambda c: c.startswith(value[:-1]))
        return self._equals(ref, value)

    def _relational_term(self, node: Term, ref: FieldRef, default: bool) -> Condition | None:
        value, is_text = node.text, isinstance(ref.dtype, T.StringType)
        operator = self.config.default_search_op if default else None
        values = [value]
        if default and self.config.tokenizer:
            found = self.config.tokenizer(ref.name, value)
            if isinstance(found, tuple):
                found, operator = found
            values = [v for v in found if v.strip()]
            if not found:
                return None
            if not values:
                return Const(False)
        fulltext = ref.name.lower() in {f.lower() for f in self.config.fulltext_fields}
        stars = is_text and not default
        if stars and len(value) > 1 and value.startswith("*") and value.endswith("*"):
            operator, values = "contains", [value[1:-1]]
        elif stars and value.endswith("*"):
            operator, values = "starts_with", [value[:-1]]
        if not is_text or operator in (None, "equals"):
            return many([self._equals(ref, v) for v in values], False)
        if fulltext:
            return many([self._text(ref, lambda c, v=v: text.token_prefix(c, v)) for v in values], False)
        test = (lambda c, v: c.contains(v)) if operator == "contains" else (lambda c, v: c.startswith(v))
        return many([self._text(ref, lambda c, v=v: test(c, v)) for v in values], False)

    # ranges

    def _range(self, node: Range, ref: FieldRef) -> Condition:
        low, high = Range.bound(node.low), Range.bound(node.high)
        if ref.geo:
            if low is None or high is None:
                raise Unsupported(f"{node} needs both corners")
            a, b = geo.location(self._place(low)), geo.location(self._place(high))
            return Leaf(ref, lambda c: geo.in_box(*self._lat_lon(c, ref), a, b))
        if self.relational and (node.boost is not None or node.proximity is not None):
            self.context.result.warnings.append(f"{node}: ranges have no boost or proximity here")
        if isinstance(ref.dtype, DATES):
            return self._date_span(ref, low, high, node.low_inclusive, node.high_inclusive, node.boost)
        if self.relational and isinstance(ref.dtype, T.StringType | T.BooleanType):
            self.context.result.warnings.append(f"{node}: the field is no number and no date")
        tests: list[tuple[str, object]] = []
        for bound, sign in ((low, ">=" if node.low_inclusive else ">"), (high, "<=" if node.high_inclusive else "<")):
            if bound is None:
                continue
            literal = typed(bound, ref.dtype)
            if literal is None and isinstance(ref.dtype, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
                # a bound beyond the type, or between two whole numbers
                literal = typed(bound, T.DoubleType())
                literal = None if literal is None or math.isnan(literal) else literal
            if literal is None:
                return Const(False)
            tests.append((sign, F.lit(literal)))
        return self._between(ref, tests)

    @staticmethod
    def _between(ref: FieldRef, tests: list[tuple[str, Column]]) -> Condition:
        if not tests:
            return Leaf(ref, lambda c: c.isNotNull(), lambda c: c.isNull())
        compare = {">=": lambda c, x: c >= x, ">": lambda c, x: c > x, "<=": lambda c, x: c <= x, "<": lambda c, x: c < x}
        other = {">=": "<", ">": "<=", "<=": ">", "<": ">="}

        def yes(c: Column) -> Column:
            out = compare[tests[0][0]](c, tests[0][1])
            return out & compare[tests[1][0]](c, tests[1][1]) if len(tests) > 1 else out

        def no(c: Column) -> Column:
            out = c.isNull()
            for sign, x in tests:
                out = out | compare[other[sign]](c, x)
            return out

        return Leaf(ref, yes, no)

    def _date_span(self, ref: FieldRef, low: str | None, high: str | None, low_in: bool, high_in: bool, tz: str | None) -> Condition:
        """Bounds that name a whole unit are widened to it: `gt` and `lte` count from its end, `gte` and `lt` from its start."""
        tz = tz or self.config.timezone
        tests: list[tuple[str, Column]] = []
        for bound, inclusive, is_low in ((low, low_in, True), (high, high_in, False)):
            if bound is None:
                continue
            try:
                if self.config.date_parser:
                    start = self.config.date_parser(bound)
                    end = start + dt.timedelta(microseconds=1)
                else:
                    if self.relational:
                        datemath.strict(bound, isinstance(ref.dtype, T.DateType))
                    start, end = datemath.evaluate(bound, self.config.now, tz)
            except datemath.DateMathError as e:
                if self.relational:
                    raise Unsupported(str(e)) from None
                return Const(False)
            moment = start if inclusive == is_low else end
            if isinstance(ref.dtype, T.DateType):
                day = moment.date() + dt.timedelta(days=moment.time() != dt.time())
                tests.append((">=" if is_low else "<", F.lit(day)))
            else:
                tests.append((">=" if is_low else "<", instant(moment, ref.dtype)))
        return self._between(ref, tests)

    # places

    def _place(self, value: str) -> str:
        return (self.config.geo_resolver(value) if self.config.geo_resolver else None) or value

    @staticmethod
    def _lat_lon(c: Column, ref: FieldRef) -> tuple[Column, Column]:
        if isinstance(ref.dtype, T.StringType):
            # points that aren't `lat,lon` are nowhere
            parts = F.split(c, ",")
            return tuple(F.try_element_at(parts, F.lit(i)).try_cast("double") for i in (1, 2))
        return c.getField("lat"), c.getField("lon")

    def _geo_distance(self, node: Term, ref: FieldRef) -> Condition:
        centre = geo.location(self._place(node.text))
        metres = geo.distance_metres(node.proximity or None)
        return Leaf(ref, lambda c: geo.within(*self._lat_lon(c, ref), centre, metres))


__all__ = ["Many", "PredicateCompiler", "Unsupported", "typed"]
