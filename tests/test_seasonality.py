import pytest
from pyspark.sql import functions as F

from cadenza.operators import seasonality as s


@pytest.mark.parametrize("x,df,p", [
    (19.6751, 11, .05), (24.7250, 11, .01), (3.8415, 1, .05),
    (9.2103, 2, .01), (5.5778, 11, .9)])
def test_chi_square_tail(spark, x, df, p):
    tail = s.chi_square_tail(F.lit(x), F.lit(df))
    got = spark.range(1).select(tail).collect()[0][0]
    assert got == pytest.approx(p, abs=3e-3 if df == 1 else 1e-5)


def test_rolling_needs_a_full_frame(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(6)],
                               "t int, v double")
    got = [r.v_ma for r in s.rolling(df, "t", ["v"], 4).orderBy("t").collect()]
    assert got == [None, None, None, 1.5, 2.5, 3.5]
