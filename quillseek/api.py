"""QueryEngine: filter, aggregate and sort any DataFrame with expressions."""

from __future__ import annotations

import datetime as dt
import logging
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from dataclasses import field as dc_field
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lang import Node, Op, QueryParseError, Term, parse
from .lang.ast import Group, dump, walk
from .operators.aggregate import Aggregator
from .operators.predicate import PredicateCompiler
from .operators.sort import sort_columns
from .plans.tree import to_tree
from .rewrite import Chain, Context, ValidationError, ValidationOptions, ValidationResult, check, cleanup, expand_includes, hierarchical, invert, remove_fields, resolve_fields
from .rewrite.kinds import aggregation_tree
from .sources import FieldCatalog, Relation
from .streaming import require_batch


@dataclass
class EngineConfig:
    mode: str = "search"
    default_operator: Op | str = Op.AND
    default_fields: tuple[str, ...] = ()
    default_search_op: str = "starts_with"
    fulltext_fields: tuple[str, ...] = ()
    analyzed_fields: tuple[str, ...] = ()
    sort_fields: tuple[str, ...] = ()
    geo_fields: tuple[str, ...] = ()
    aliases: dict[str, str] = dc_field(default_factory=dict)
    field_map: dict[str, str] | None = None
    field_resolver: Callable[[str], str | None] | None = None
    includes: dict[str, str] | Callable[[str], str | None] | None = None
    include_name: str = "include"
    skip_include: Callable | None = None
    geo_resolver: Callable[[str], str | None] | None = None
    nested_filter: Callable[[str], str | Column | None] | None = None
    #: name -> (Spark SQL expression or Column, type)
    runtime_fields: dict[str, tuple[str | Column, T.DataType]] = dc_field(default_factory=dict)
    relations: dict[str, Relation] = dc_field(default_factory=dict)
    tokenizer: Callable[[str, str], list[str] | tuple[list[str], str]] | None = None
    date_parser: Callable[[str], dt.datetime] | None = None
    timezone: str = "UTC"
    clock: Callable[[], dt.datetime] | None = None
    required_mode: str = "relational"
    default_terms_size: int = 10
    tophits_order: str = ""
    #: Approximate distinct counts and percentiles: bounded memory for any number of values.
    approx: bool = False
    #: Whether bucket frames come sorted; without, all buckets of a `~0` skip a global sort.
    ordered: bool = True
    strict_scope: bool = False
    max_depth: int = 10
    field_filter: Callable[[str], bool] | None = None
    #: Off unless named: "wildcards", "regex", "fuzzy", "dots" (`f:1..5`), "count" (`count:_`).
    extensions: frozenset[str] = frozenset()
    validation: ValidationOptions = dc_field(default_factory=ValidationOptions)
    #: Told of every compiled expression (debug) and of what was left out of it (warning).
    logger: logging.Logger = dc_field(default_factory=lambda: logging.getLogger("quillseek"))

    def now(self) -> dt.datetime:
        return self.clock() if self.clock else dt.datetime.now(dt.UTC)


@dataclass
class SearchResult:
    rows: DataFrame
    aggregations: dict[str, DataFrame]


def _terms_to_fields(node: Node, context: Context) -> Node:
    """In sort expressions a bare term is a field."""
    for n in walk(node):
        if isinstance(n, Term) and not n.field:
            n.field, n.term = n.term, ""
    return node


def _resolve_terms(resolver: Callable[[str], str | None]) -> Callable[[Node, Context], Node]:
    """In aggregation expressions the fields are terms."""

    def resolve(node: Node, context: Context) -> Node:
        for n in walk(node):
            if isinstance(n, Term) and not (n.field or "").startswith("@") and n.text != "_":
                found = (context.field_resolver or resolver)(n.text) if context.field_resolver else resolver(n.text)
                if found and found != n.text:
                    n.data["original_term"], n.term = n.text, found
        return node

    return resolve


class QueryEngine:
    """Compiles expressions on the driver; all data work is native Spark.

    `chains` holds the rewrites of each kind of expression (query, aggregation, sort): include 0,
    fields 10, validation 30. Callers may add their own.
    """

    def __init__(self, config: EngineConfig | None = None, catalog: FieldCatalog | None = None, **options: Any):
        self.config = replace(config or EngineConfig(), **options)
        if isinstance(self.config.default_operator, str):
            self.config.default_operator = Op[self.config.default_operator.upper()]
        self._catalog = catalog
        self._kept: list[DataFrame] = []
        c = self.config
        mapped = hierarchical(c.field_map) if c.field_map else None
        names = [r for r in (c.field_resolver, mapped) if r]
        resolve = lambda f: next((x for r in names if (x := r(f)) is not None), None)
        fields = resolve_fields(lambda f: resolve(f) or f)
        self.chains = {
            "query": Chain((0, expand_includes), (10, fields), (30, check)),
            "aggregation": Chain((0, expand_includes), (10, _resolve_terms(resolve)), (30, check)),
            "sort": Chain((0, expand_includes), (5, _terms_to_fields), (10, fields), (30, check)),
        }

    # trees

    def context(self, kind: str = "query", **bag: Any) -> Context:
        c = self.config
        return Context(kind=kind, default_operator=c.default_operator, default_fields=c.default_fields, includes=c.includes, include_name=c.include_name, skip_include=c.skip_include, options=c.validation, bag=bag)

    def parse(self, expression: str, kind: str = "query", context: Context | None = None) -> Node:
        """The rewritten tree. Syntax errors raise; what validation finds raises unless a context collects it."""
        own = context or self.context(kind)
        node = self.chains[kind](parse(expression), own)
        if not own.result.is_valid and (context is None or own.options.throw):
            raise ValidationError(own.result)
        return node if node is not None else Group()

    def explain(self, expression: str, kind: str = "query") -> str:
        return dump(self.parse(expression, kind))

    def validate(self, expression: str, kind: str = "query", options: ValidationOptions | None = None) -> ValidationResult:
        context = self.context(kind)
        context.options = options or self.config.validation
        context.result.kind = kind
        try:
            self.parse(expression, kind, context)
            if kind == "aggregation":
                aggregation_tree(parse(expression), context)
        except QueryParseError as e:
            context.result.error(e.message, e.column)
        if context.options.throw and not context.result.is_valid:
            raise ValidationError(context.result)
        return context.result

    def validate_query(self, expression: str, options: ValidationOptions | None = None) -> ValidationResult:
        return self.validate(expression, "query", options)

    def validate_aggregations(self, expression: str, options: ValidationOptions | None = None) -> ValidationResult:
        return self.validate(expression, "aggregation", options)

    def validate_sort(self, expression: str, options: ValidationOptions | None = None) -> ValidationResult:
        return self.validate(expression, "sort", options)

    def invert(self, expression: str, keep: Iterable[str] = (), alternate: str | None = None) -> str:
        return str(invert(parse(expression), keep, alternate, self.config.default_operator))

    def cleanup(self, expression: str) -> str:
        return str(cleanup(parse(expression)))

    def remove_fields(self, expression: str, fields: Iterable[str] | Callable[[str], bool]) -> str:
        return str(remove_fields(parse(expression), fields))

    # data

    def catalog_for(self, df: DataFrame) -> FieldCatalog:
        if self._catalog is not None:
            return self._catalog
        c = self.config
        return FieldCatalog(df.schema, aliases=dict(c.aliases), analyzed={f.lower() for f in c.analyzed_fields}, sort_forms={f.lower() for f in c.sort_fields}, geo=set(c.geo_fields), computed=dict(c.runtime_fields), relations=dict(c.relations), max_depth=c.max_depth, field_filter=c.field_filter)

    def allow_list(self, df: DataFrame) -> ValidationOptions:
        """Options that allow the fields of df and of its relations, and no others."""
        return replace(self.config.validation, allowed_fields=set(self.catalog_for(df).field_names()))

    def _compiler(self, df: DataFrame, context: Context) -> PredicateCompiler:
        return PredicateCompiler(self.config, self.catalog_for(df), context)

    def _tell(self, context: Context) -> None:
        for warning in context.result.warnings:
            self.config.logger.warning("%s: %s", context.kind, warning)
        if context.result.unresolved_fields:
            self.config.logger.warning("%s: unknown fields %s", context.kind, ", ".join(sorted(context.result.unresolved_fields)))

    def report(self, df: DataFrame, query: str | Node) -> dict[str, list[str]]:
        """What Spark makes of a filter: `pushed` to the scans, `left` for after them, the columns `read`, and the `joins`."""
        plan = self.filter(df, query)._jdf.queryExecution().sparkPlan()
        leaves = plan.collectLeaves()
        pushed, read = [], []
        for i in range(leaves.size()):
            if (scan := leaves.apply(i)).nodeName().startswith("Scan") and hasattr(scan, "metadata"):
                known = scan.metadata()
                if known.contains("PushedFilters"):
                    pushed += [x for x in known.apply("PushedFilters")[1:-1].split(", ") if x]
                    read += list(scan.requiredSchema().fieldNames())
        text = plan.toString()
        return {"pushed": pushed, "left": re.findall(r"Filter (\(.*\))", text), "read": read, "joins": re.findall(r"(\w+Join\w*) ", text)}

    def predicate(self, df: DataFrame, query: str | Node) -> Column:
        """The filter as a column. With relations it holds an EXISTS and belongs in a `where` of df."""
        context = self.context()
        node = self._tree(query, "query", context)
        out = self._compiler(df, context).column(node)
        self._tell(context)
        return out

    def _tree(self, expression: str | Node, kind: str, context: Context) -> Node:
        self.config.logger.debug("%s: %s", kind, expression)
        if isinstance(expression, str):
            node = self.parse(expression, kind, context)
            if not context.result.is_valid:
                raise ValidationError(context.result)
            return node
        return self.chains[kind](expression, context)

    def filter(self, df: DataFrame, query: str | Node) -> DataFrame:
        context = self.context()
        node = self._tree(query, "query", context)
        if isinstance(node, Group) and node.left is None and node.right is None:
            return df
        condition = self._compiler(df, context).column(node)
        self._tell(context)
        return df.where(condition)

    def _aggregator(self, df: DataFrame, aggs: str | Node, start: dt.datetime | None, end: dt.datetime | None) -> tuple[Aggregator, list]:
        context = self.context("aggregation", operations=("count",) if "count" in self.config.extensions else ())
        node = self._tree(aggs, "aggregation", context)
        tree = aggregation_tree(node, context)
        if not context.result.is_valid:
            raise ValidationError(context.result)
        return Aggregator(self.config, self.catalog_for(df), self._compiler(df, context), start, end), tree

    def _read_once(self, df: DataFrame, aggregator: Aggregator, tree: list) -> DataFrame:
        """df with the columns that the aggregations look at, persisted."""
        names, stack = set(), [*tree]
        while stack:
            agg = stack.pop()
            stack += agg.children
            ref = aggregator.catalog.resolve(agg.field)
            if agg.op == "tophits" or agg.ready is not None or self.config.nested_filter or (ref is not None and (ref.compute or ref.relations)):
                names = set(df.columns)
                break
            names |= {ref.path[0]} if ref is not None else set()
        kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c in names]).persist(StorageLevel.MEMORY_AND_DISK)
        self._kept.append(kept)
        return kept

    def release(self) -> None:
        """Forget what aggregations have kept with read_once."""
        while self._kept:
            self._kept.pop().unpersist()

    def aggregate(self, df: DataFrame, aggs: str | Node, start: dt.datetime | None = None, end: dt.datetime | None = None, read_once: bool = False) -> dict[str, DataFrame]:
        """A flat frame for each aggregation: `terms_x`, below it `terms_x>date_y`, ... start and end widen date buckets.

        Frames are lazy, and each reads its columns of df. With read_once the first one to run
        reads the columns of all from df and keeps them for the others, until `release`.
        """
        aggregator, tree = self._aggregator(df, aggs, start, end)
        if read_once and not df.isStreaming:
            df = self._read_once(df, aggregator, tree)
        out = aggregator.run(df, tree)
        self._tell(aggregator.compiler.context)
        return out

    def metrics(self, df: DataFrame, aggs: str | Node) -> DataFrame:
        """The metrics of an expression as one row, computed in one pass."""
        aggregator, tree = self._aggregator(df, aggs, None, None)
        return aggregator.metrics_row(df, tree)

    def aggregate_tree(self, df: DataFrame, aggs: str | Node, **more: Any) -> dict[str, DataFrame]:
        """The outermost frames, with the levels below as nested arrays."""
        flat = self.aggregate(df, aggs, **more)
        return {name: to_tree(flat, name) for name in flat if ">" not in name}

    def sort(self, df: DataFrame, sort: str | Node) -> DataFrame:
        context = self.context("sort")
        node = self._tree(sort, "sort", context)
        columns = sort_columns(node, self.catalog_for(df), self.config, self._compiler(df, context))
        if columns:
            require_batch(df, "a sort")
        return df.orderBy(*columns) if columns else df

    def search(self, df: DataFrame, query: str = "", aggs: str = "", sort: str = "", limit: int | None = None, offset: int = 0, fields: Iterable[str] | None = None, read_once: bool = False) -> SearchResult:
        """Filtered rows in order, cut to a page and to some fields; aggregations are over all filtered rows (read_once: as for `aggregate`)."""
        found = self.filter(df, query)
        rows = self.sort(found, sort)
        if offset:
            rows = rows.offset(offset)
        if limit is not None:
            rows = rows.limit(limit)
        if fields is not None:
            catalog = self.catalog_for(df)
            refs = [(f, catalog.resolve(f)) for f in fields]
            rows = rows.select(*[r.column().alias(f) for f, r in refs if r is not None])
        return SearchResult(rows, self.aggregate(found, aggs, read_once=read_once) if aggs else {})
