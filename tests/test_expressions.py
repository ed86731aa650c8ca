import datetime

import pytest

from tallytree.functions.expressions import (
    And, CompoundExpression, Equal, Equivalent, FalseExpression, GreaterThan, GreaterThanOrEqual, Implies, IsNull, LessThan, LessThanOrEqual, Not, NotEqual, Or, TrueExpression,
)

ROWS = [(1, "a", None, True), (2, "b", 5, False), (3, None, 7, True)]


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame(ROWS, "i int, s string, n long, b boolean")


def found(cells, e):
    return [r.mask for r in e.mask(cells).orderBy("i").collect()]


def test_truth_table(cells):
    assert found(cells, TrueExpression()) == [True] * 3
    assert found(cells, FalseExpression()) == [False] * 3
    assert found(cells, Equal("n", 5)) == [False, True, False]
    assert found(cells, NotEqual("n", 5)) == [True, False, True]  # null differs from everything
    for e in (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual):
        assert found(cells, e("n", 5))[0] is False
    assert found(cells, Not(LessThan("n", 6))) == [True, False, True]
    assert found(cells, Equal("n", None)) == [False] * 3
    assert found(cells, NotEqual("n", None)) == [True] * 3
    assert found(cells, IsNull("n")) == [True, False, False]
    assert found(cells, And(Equal("s", "a"), LessThan("i", 2))) == [True, False, False]
    assert found(cells, Or(Equal("s", "a"), Equal("i", 3))) == [True, False, True]
    assert found(cells, Implies(Equal("s", "a"), Equal("i", 2))) == [False, True, True]
    assert found(cells, Equivalent(Equal("s", "a"), Equal("i", 1))) == [True, True, True]


def test_kinds(cells):
    assert found(cells, Equal("i", "x")) == [False] * 3
    assert found(cells, NotEqual("s", 1)) == [True] * 3
    assert found(cells, Equal("b", True)) == [True, False, True]
    assert found(cells, Equal("i", datetime.date(2020, 1, 1))) == [False] * 3
    with pytest.raises(TypeError):
        found(cells, LessThan("i", "x"))
    with pytest.raises(ValueError):
        found(cells, Equal("nothing", 1))


def test_arity_and_text():
    with pytest.raises(ValueError):
        And()
    with pytest.raises(TypeError):
        Or(TrueExpression(), 3)
    with pytest.raises(TypeError):
        CompoundExpression([1])
    assert repr(Implies(NotEqual("P02", 1), And(Equal("P03A", 98), LessThan("x", "y")))) == "Implies(NotEqual('P02', 1), And(Equal('P03A', 98), LessThan('x', 'y')))"
