"""Required and prohibited operands over all combinations of four tests."""

import itertools

import pytest

from quillseek.api import QueryEngine

CASES = [
    ("+a:1", lambda a, b, c, d: a), ("a:1 AND +b:1", lambda a, b, c, d: a and b), ("a:1 OR +b:1", lambda a, b, c, d: b),
    ("a:1 OR +b:1 AND c:1", lambda a, b, c, d: b and c), ("a:1 OR +b:1 AND c:1 OR d:1", lambda a, b, c, d: b and (c or d)),
    ("a:1 AND +b:1 OR c:1", lambda a, b, c, d: a and b), ("a:1 OR (+b:1 AND c:1)", lambda a, b, c, d: a or (b and c)),
    ("a:1 OR b:1 OR +c:1", lambda a, b, c, d: c), ("+a:1 OR +b:1", lambda a, b, c, d: a and b), ("a:1 OR +b:1 OR +c:1", lambda a, b, c, d: b and c),
    ("a:1 OR +b:1 OR -c:1", lambda a, b, c, d: b and not c), ("a:1 OR +(b:1 OR c:1)", lambda a, b, c, d: b or c), ("(a:1 OR +b:1) AND c:1", lambda a, b, c, d: b and c),
    ("a:1 OR NOT b:1", lambda a, b, c, d: a or not b), ("a:1 OR !b:1", lambda a, b, c, d: a or not b), ("a:1 OR b:1 OR -c:1", lambda a, b, c, d: a or b or not c),
    ("-a:1 OR -b:1", lambda a, b, c, d: not a or not b), ("a:1 OR -b:1 AND c:1", lambda a, b, c, d: a or (not b and c)), ("a:1 OR b:1 AND -c:1", lambda a, b, c, d: a or (b and not c)),
    ("a:1 OR -b:1 AND c:1 OR d:1", lambda a, b, c, d: a or (not b and (c or d))), ("a:1 OR (-b:1 AND c:1)", lambda a, b, c, d: a or (not b and c)), ("NOT (a:1 OR +b:1)", lambda a, b, c, d: not b),
]


@pytest.fixture(scope="module")
def combinations(spark):
    return spark.createDataFrame(list(itertools.product([0, 1], repeat=4)), "a int, b int, c int, d int").cache()


@pytest.mark.parametrize("mode", ["search", "relational"])
@pytest.mark.parametrize(("query", "want"), CASES)
def test_truth_table(combinations, mode, query, want):
    got = {tuple(r) for r in QueryEngine(mode=mode).filter(combinations, query).collect()}
    assert got == {x for x in itertools.product([0, 1], repeat=4) if want(*x)}
