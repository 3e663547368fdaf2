"""Parsing, printing and rewriting: no Spark."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillseek.lang import Group, Op, QueryParseError, Range, Term, parse
from quillseek.rewrite import Context, ValidationOptions, cleanup, expand_includes, hierarchical, invert, referenced_fields, remove_fields, resolve_fields
from quillseek.rewrite.chain import Chain
from quillseek.rewrite.kinds import aggregation_tree, sort_terms
from quillseek.api import QueryEngine
from quillseek.rewrite import ValidationError

KEPT = [
    "*", '"a phrase"', "word", "(word)", "f:word", "-word", "+word", "a AND NOT b", "a NOT b", "a OR b OR c", "a OR (b AND c)",
    "f:[1 TO 2]", "f:{1 TO 2}", "f:[1 TO 2}", "f:[1..5}", "f:(a OR b)", "f:c*r", "d:>now", "d:<now-1d/d", "_exists_:t", "_missing_:t",
    r"book.\*:(quick brown)", "d:[now/d-4d TO now/d+1d}", "d:[* TO 2012-12-31]", "a~", "a~1", "r~0.8", "a^2", '"a b"~1', "f:(\"W\"~2)",
    "a:(>30 AND <=40)", "+>=10", "a:(+>=10 +<20)", "t:(full text)^2", "x:[* TO 10]^zone", 'geo:"Dallas, TX"~75m', r"dh:(date~2^-5\:30 min:date)",
    "(NOT -(stuff))", "NOT Test", "! Test", "!Test", "One - Two", r"type:\(11\)2\+", r'"\"now"', "ANDmammoth", "xy/z", "/re.*/", 'T:""',
]


@pytest.mark.parametrize("text", KEPT)
def test_prints_what_it_parsed(text):
    assert str(parse(text)) == text


@pytest.mark.parametrize(("text", "shown"), [("f :x", "f:x"), ("a : >= 10", "a:>=10"), ("( ( a AND b ))", "((a AND b))"), (" \t", ""), ("OR a", "a"), ("a AND ", "a"), ("a AND", "a AND")])
def test_normal_form(text, shown):
    assert str(parse(text)) == shown


@pytest.mark.parametrize(("text", "message", "column"), [(":", "Unexpected character ':'.", 0), ("c:a:a", "Unexpected character ':'.", 3), ("Hello (world", "Missing closing paren", 12), ('Hello "world', "Unterminated quoted", 12), ("/abc", "Unterminated regex", 4)])
def test_errors_have_a_column(text, message, column):
    with pytest.raises(QueryParseError) as e:
        parse(text)
    assert message in e.value.message
    assert e.value.column == column


def test_chain_has_no_precedence():
    root = parse("a:1 AND b:2 OR c:3")
    assert root.op is Op.AND and isinstance(root.right, Group) and root.right.op is Op.OR
    assert isinstance(parse("a").left, Term) and parse("a").right is None
    r = parse("NOT f:[1 TO *}").left
    assert isinstance(r, Range) and r.excluded and r.low_inclusive and not r.high_inclusive and Range.bound(r.high) is None
    assert parse("a~").left.proximity == "" and parse("NOT -x").left.excluded


def test_long_chains_need_no_recursion():
    text = " OR ".join(f"f:{i}" for i in range(5000))
    assert str(parse(text).clone()) == text


words = st.from_regex(r"[a-z]{1,4}", fullmatch=True)
leaves = st.builds(lambda neg, f, w: f"{neg}{f}:{w}", st.sampled_from(["", "NOT ", "-", "+"]), words, words)
queries = st.recursive(leaves, lambda q: st.builds(lambda a, op, b: f"({a}{op}{b})", q, st.sampled_from([" ", " AND ", " OR "]), q), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(queries)
def test_round_trip_of_random_queries(q):
    assert str(parse(q)) == q
    assert str(parse(str(parse(q).clone()))) == q


@pytest.mark.parametrize(("q", "w"), [("(((v)))", "v"), ("t:((v))", "t:(v)"), ("NOT (v)", "NOT v"), ("NOT (s:f)", "NOT s:f"), ("p:1 NOT (s:o OR s:r)", "p:1 NOT (s:o OR s:r)")])
def test_cleanup(q, w):
    assert str(cleanup(parse(q))) == w


@pytest.mark.parametrize(
    ("q", "w", "alternate"),
    [
        ("gone", "(NOT gone)", None), ("s:open", "(NOT s:open)", None), ("NOT s:open", "s:open", None), ("a:1 b:2 c:3", "(NOT (a:1 b:2 c:3))", None),
        ("(a:1 OR b:2)", "(NOT (a:1 OR b:2))", None), ("f:v org:1", "(NOT f:v) org:1", None), ("v", "(d:true OR (NOT v))", "d:true"),
        ("org:1 (a:1 OR b:2)", "org:1 (d:true OR (NOT (a:1 OR b:2)))", "d:true"), ("(a:1 org:1) b:2", "((NOT a:1) org:1) (NOT b:2)", None), ("org:1", "org:1", None),
    ],
)
def test_invert(q, w, alternate):
    assert str(invert(parse(q), ["org"], alternate)) == w


def test_invert_refuses_or_as_default():
    with pytest.raises(ValueError):
        invert(parse("a b"), default_operator=Op.OR)


def test_default_operator_is_written_out():
    assert parse("(a b) OR (c d)").shown(Op.AND) == "(a AND b) OR (c AND d)"


def test_includes():
    c = Context(includes={"a": "x:1 @include:b", "b": "y:2", "loop": "@include:loop", "bad": "(x"})
    assert str(expand_includes(parse("z NOT @include:a"), c)) == "z NOT (x:1 (y:2))"
    expand_includes(parse("@include:loop"), c)
    expand_includes(parse("@include:bad"), c)
    assert any("Recursive" in m for m, _ in c.result.errors) and any("Error in include bad" in m for m, _ in c.result.errors)
    expand_includes(parse("@include:nobody"), c)
    assert c.result.unresolved_includes == {"nobody"}


def test_fields():
    resolve = hierarchical({"f": "q.r", "f.x": "direct"})
    assert (resolve("f.x"), resolve("F.y"), resolve("g")) == ("direct", "q.r.y", "g")
    c = Context(field_resolver=lambda f: "own" if f == "g" else None)
    node = resolve_fields(resolve)(parse("f:1 g:2"), c)
    assert str(node) == "q.r:1 own:2" and node.left.data["original_field"] == "f"
    assert referenced_fields(parse("a:1 (b:2 OR c:(x y)) z"), ["d"]) == {"a", "b", "c", "d"}
    assert str(remove_fields(parse("f:1 (g:2 OR h:3) i:(4 5)"), ["G", "i"])) == "f:1 (h:3)"


def test_chain_management():
    log = []
    step = lambda name: lambda n, c: log.append(name) or n
    a, b, d = step("a"), step("b"), step("d")
    chain = Chain((10, a)).add(b, 5).add_after(a, d)
    chain(parse("x"), None)
    chain.remove(b).replace(a, step("z")).add_before(d, step("y"))
    log.append("|")
    chain(parse("x"), None)
    assert log == ["b", "a", "d", "|", "z", "y", "d"]
    # without a priority the new one runs one place earlier than the old one did
    log.clear()
    Chain((9, a), (10, b)).replace(b, step("n"))(parse("x"), None)
    Chain((10, a), (10, b)).replace(b, step("n"))(parse("x"), None)
    assert log == ["a", "n", "n", "a"]


def test_visitor():
    from quillseek.rewrite import Visitor

    class Names(Visitor):
        def __init__(self):
            self.result = []

        def group(self, node, context):
            self.result.append(node.name or "group")
            return node.name != "skip"

        def leaf(self, node, context):
            self.result.append(node.name)

        def missing(self, node, context):
            self.result.append("missing")

    assert Names().visit(parse("a:1 b:[1 TO 2] skip:(c:1 d:2) _missing_:e _exists_:f")) == ["group", "a", "group", "b", "group", "skip", "group", "missing", "f"]
    assert Names().visit(None) == []
    node = parse("a:1")
    names = Names()
    assert Chain((1, names))(node, None) is node and names.result == ["group", "a"]


def test_aggregation_tree():
    c = Context(kind="aggregation")
    (agg,) = aggregation_tree(parse("terms:(f~5^2 @exclude:x -max:g terms:(h~3))"), c)
    assert (agg.name, agg.field, agg.proximity, agg.boost) == ("terms_f", "f", "5", "2")
    assert [x.name for x in agg.children] == ["max_g", "terms_h"] and agg.children[0].prefix == "-" and agg.option("exclude")[0].text == "x"
    hoisted = aggregation_tree(parse("min:(f max:g) count:x"), c)
    assert [x.name for x in hoisted] == ["max_g"] and len(c.result.warnings) == 2


def test_sort_terms():
    assert [(t.text, d) for t, d in sort_terms(parse("a -b -(c d +e) NOT f"))] == [("a", False), ("b", True), ("c", True), ("d", True), ("e", False), ("f", True)]


def test_validation():
    engine = QueryEngine()
    info = engine.validate_query(":")
    assert not info.is_valid and "Unexpected" in info.message
    allow = ValidationOptions(allowed_fields={"ok"})
    assert engine.validate_query("blah ok:1", allow).is_valid and not engine.validate_query("no:1", allow).is_valid
    assert not engine.validate_query("a NO:1", ValidationOptions(restricted_fields={"no"})).is_valid
    assert "wildcard" in engine.validate_query("f:*x", ValidationOptions(allow_leading_wildcards=False)).message
    deep = engine.validate_query("(a (b (c)))", ValidationOptions(max_depth=3))
    assert deep.depth == 4 and not deep.is_valid
    assert not engine.validate_query("@include:x").is_valid
    ops = engine.validate_aggregations("terms:(f min:g) max:g", ValidationOptions(restricted_operations={"max"}))
    assert ops.operations == {"terms": {"f"}, "min": {"g"}, "max": {"g"}} and not ops.is_valid
    assert engine.validate_sort("-a b", ValidationOptions(allowed_fields={"a"})).fields == {"a", "b"}
    assert "[0]" not in engine.validate_query("no:1", allow).message
    with pytest.raises(ValidationError):
        engine.validate_query("no:1", ValidationOptions(allowed_fields={"ok"}, throw=True))
    renamed = QueryEngine(field_map={"ok": "idx1"})
    assert renamed.validate_query("ok:1", allow).is_valid and not renamed.validate_query("idx1:1", allow).is_valid
