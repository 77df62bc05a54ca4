import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weirflow.functions.expr import Expression, ExpressionError
from weirflow.functions.numbers import ceil_div, floor_div, rational, saturating_add, truncated

GOLDEN = {
    "4*3": 12, "3-4": -1, "4/3": 4 / 3, "4^3": 64, "8!": 40320, "(2^3)!": 40320, "2^3!": 64, "4*5%3": 8, "(4*5)%3": 2,
    "(2+2)(2 + 2)": 16, "2 >= 1+1": 1, "if(or(0,0), 4, 5)": 5, "4cos(0.2)4": 16 * math.cos(0.2), "max(max(0.2,0.3*2), 0.21)": 0.6,
    "min(0.2 * 0.1, 0.21)": 0.02, "(-2+5)": 3, "": 0, "2^3^2": 512, "2^0": 1, "log10(1000)": 3, "PI": math.pi, "2 * 3 + 4": 10,
}


@pytest.mark.parametrize(("text", "value"), GOLDEN.items())
def test_values(text, value):
    assert Expression(text).double() == pytest.approx(value)


@pytest.mark.parametrize("text", ["cos", "+", "cos(+)", "cos(1+)", "4+", "+2", "-2", "max(1,)", "(2", "2)", "4*/2", "1e3", "width", "2 $ 3", "max(1,2,3)"])
def test_refused(text):
    with pytest.raises(ExpressionError):
        Expression(text).double()


def test_parameters_and_truncation():
    e = Expression("if(X > 0, 4, 5)")
    assert (e.value({"x": 0}), e.value({"X": 1})) == (5, 4)
    assert e.parameters == {"x"} and not e.static and Expression("3*4").static
    assert Expression("7/2").value() == 3 and Expression("(-7)/2").value() == -3
    with pytest.raises(ExpressionError):
        Expression("1/0").value()


def test_equality_is_structural():
    assert Expression("3*w") == Expression("3 * W") and Expression("3*w") != Expression("w*3")
    assert Expression("4*x*3").reordered().infix() == "(12*x)"


def test_columns_follow_ieee(spark):
    cases = {"1/x": math.inf, "log(x)": -math.inf, "x/x": math.nan, "5 % x": math.nan, "log(x-1)": math.nan, "sqrt(x-1)": math.nan, "(x/x) == (x/x)": 0.0, "25!": math.factorial(25), "max(2, x/x)": 2.0, "if(x + 0.5, 1, 2)": 2.0}
    row = spark.createDataFrame([(0.0,)], "x double").select(*[Expression(t).column().alias(f"c{k}") for k, t in enumerate(cases)]).first()
    for k, (text, want) in enumerate(cases.items()):
        got = row[f"c{k}"]
        assert got == pytest.approx(want, rel=1e-12) or (math.isnan(want) and math.isnan(got)), text
        driver = Expression(text).double({"x": 0.0})
        assert driver == pytest.approx(want, rel=1e-12) or (math.isnan(want) and math.isnan(driver)), text


def test_column_names(spark):
    assert spark.range(3).select(Expression("2width").column({"width": F.col("id")}).alias("y")).agg(F.sum("y")).first()[0] == 6


@given(st.integers(-50, 50), st.integers(-50, 50).filter(bool))
def test_numbers(a, b):
    assert floor_div(a, b) == math.floor(a / b) and ceil_div(a, b) == math.ceil(a / b)
    assert truncated(rational(a, b)) == int(a / b)


def test_saturation():
    assert saturating_add((1 << 63) - 2, 5) == (1 << 63) - 1
    with pytest.raises(ZeroDivisionError):
        rational(1, 0)
