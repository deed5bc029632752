import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from verseflux.functions.stats import (
    numeric,
    pearson,
    pearson_p_value,
    significance,
    single_valued,
    three_decimals,
)
from verseflux.operators.correlate import (
    add_significance,
    compare_groups,
    correlate_features,
    correlate_joined,
    correlation_matrix,
)
from verseflux.operators.describe import _keys, _value, describe_features
from verseflux.operators.keys import join_canonical
from verseflux.operators.regression import bootstrap_band, regression_band, regression_line

NAN = float("nan")


def test_p_value_closed_forms():
    for r in (-0.99, -0.5, -0.1, 0.0, 0.3, 0.7, 0.999):
        assert pearson_p_value(r, 3) == pytest.approx(1 - 2 / math.pi * math.asin(abs(r)), abs=1e-12)
        assert pearson_p_value(r, 4) == pytest.approx(1 - abs(r), abs=1e-12)
    assert pearson_p_value(0.4, 2) == 1.0
    assert pearson_p_value(0.4, 1) is None
    assert pearson_p_value(NAN, 10) is None
    assert pearson_p_value(1.0, 10) == 0.0


def test_p_value_large_samples():
    # For many rows the statistic r * sqrt(n) is normal.
    for n in (10**6, 10**9, 10**12):
        for z in (0.1, 1.0, 1.959963984540054, 4.0):
            r = z / math.sqrt(n)
            assert pearson_p_value(r, n) == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-4)


def test_p_value_decreases_with_r():
    values = [pearson_p_value(r / 100, 50) for r in range(101)]
    assert values == sorted(values, reverse=True)
    assert values[0] == 1.0 and all(0 <= v <= 1 for v in values)


def r_of(spark, rows, policy="propagate"):
    df = spark.createDataFrame(rows, "x double, y double")
    return numeric(df, ["x", "y"]).agg(F.expr(f"{pearson('x', 'y', policy)} AS r")).first().r


def test_pearson_undefined_is_null(spark):
    assert r_of(spark, [(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)]) is None  # constant
    assert r_of(spark, [(1.0, 5.0)]) is None
    assert r_of(spark, [(1.0, 2.0), (2.0, 4.0)]) == pytest.approx(1.0)


def test_missing_value_policies(spark):
    rows = [(1.0, 2.0), (2.0, 1.0), (3.0, 5.0)]
    expected = np.corrcoef(np.array(rows).T)[0, 1]
    for gap in ((None, 4.0), (4.0, None), (NAN, 4.0), (4.0, NAN)):
        assert r_of(spark, [*rows, gap]) is None
        assert r_of(spark, [*rows, gap], "pairwise") == pytest.approx(expected)
    with pytest.raises(ValueError):
        pearson("x", "y", "drop")


def test_single_valued(spark):
    df = spark.createDataFrame(
        [("one", 1.0), ("one", None), ("two", 1.0), ("two", 2.0), ("none", None)], "k string, v double"
    )
    found = {r.k: r.s for r in df.groupBy("k").agg(F.expr(f"{single_valued('v')} AS s")).collect()}
    assert found == {"one": True, "two": False, "none": False}


def outcome_table(spark):
    rows = [
        ("a", 1.0, 0.9, 1.0), ("a", 1.0, 0.8, 2.0), ("a", 1.0, 0.6, 3.0),  # one label only
        ("b", 1.0, 0.9, 1.0), ("b", -1.0, 0.8, 2.0), ("b", -1.0, 0.7, 4.0),
        ("c", 1.0, 0.9, 7.0), ("c", -1.0, 0.8, 7.0),  # constant feature
    ]
    return spark.createDataFrame(rows, "source string, code double, score double, f double")


def test_outcome_is_chosen_per_group(spark):
    df = outcome_table(spark)
    got = {r.source: r for r in correlate_features(df, "code", ["f"], "score", ["source"]).collect()}
    assert got["a"].outcome == "score" and got["b"].outcome == "code"
    assert got["a"].correlation == pytest.approx(np.corrcoef([0.9, 0.8, 0.6], [1, 2, 3])[0, 1])
    assert got["b"].correlation == pytest.approx(np.corrcoef([1, -1, -1], [1, 2, 4])[0, 1])
    assert got["c"].correlation is None and got["c"].p_value is None
    assert got["c"].small_sample and got["c"].sample_size == 2


def test_result_order_and_missing_last(spark):
    df = outcome_table(spark).withColumn("g", -F.col("f")).withColumn("k", F.lit(3.0))
    rows = correlate_features(df, "code", ["f", "k", "g"]).collect()
    assert [r.feature for r in rows][-1] == "k" and rows[-1].correlation is None
    assert rows[0].correlation > rows[1].correlation


def test_group_comparison_shapes(spark):
    df = outcome_table(spark)
    assert compare_groups(df, "source", "code", ["f"], "score").count() == 3
    wide = compare_groups(df, "source", "code", ["f"], "score", groups=["a", "b"])
    assert wide.columns == ["feature", "a_correlation", "a_p_value", "b_correlation", "b_p_value"]
    with pytest.raises(ValueError):
        compare_groups(df.drop("source"), "source", "code", ["f"])


def test_joined_correlation_equals_join_then_correlation(spark):
    rng = np.random.default_rng(7)
    # One key holds a third of the rows on both sides; values sit far from zero.
    left = [("Hot Song" if i % 3 == 0 else f"Song {i % 17}", 1e6 + rng.normal()) for i in range(300)]
    right = [("HOT SONG" if i % 3 == 0 else f"song {i % 19}", 1e6 + rng.normal(), float(i % 5)) for i in range(90)]
    a = spark.createDataFrame(left, "title string, y double")
    b = spark.createDataFrame(right, "title string, f double, g double")
    joined = join_canonical(a, b)
    expected = {r.feature: r for r in correlate_features(joined, "y", ["f", "g"]).collect()}
    from verseflux.functions.text import canonical_title

    keyed = [d.withColumn("title", canonical_title("title")) for d in (a, b)]
    got = {r.feature: r for r in correlate_joined(*keyed, "title", "y", ["f", "g"]).collect()}
    for f in ("f", "g"):
        assert got[f].sample_size == expected[f].sample_size > 3000
        assert got[f].correlation == pytest.approx(expected[f].correlation, abs=1e-9)
        assert got[f].p_value == pytest.approx(expected[f].p_value, abs=1e-7)


def test_joined_correlation_fallback_and_gaps(spark):
    a = spark.createDataFrame([("x", 1.0, 0.5), ("y", 1.0, 0.7), ("z", 1.0, 0.9)], "t string, c double, s double")
    b = spark.createDataFrame([("x", 1.0, 1.0), ("y", 2.0, None), ("z", 5.0, 2.0), ("w", None, 1.0)], "t string, f double, g double")
    got = {r.feature: r for r in correlate_joined(a, b, "t", "c", ["f", "g"], "s").collect()}
    assert got["f"].outcome == "s"
    assert got["f"].correlation == pytest.approx(np.corrcoef([0.5, 0.7, 0.9], [1, 2, 5])[0, 1])
    assert got["g"].correlation is None  # a missing value among the joined rows
    nothing = correlate_joined(a, b.where("false"), "t", "c", ["f"], "s").first()
    assert nothing.sample_size == 0 and nothing.correlation is None


def test_matrix_is_symmetric(spark):
    df = outcome_table(spark).withColumn("k", F.lit(1.0))
    cells = {(r.feature_a, r.feature_b): r.correlation for r in correlation_matrix(df, ["code", "f", "k"]).collect()}
    assert len(cells) == 9
    assert cells["code", "f"] == cells["f", "code"] and cells["f", "f"] == 1.0
    assert cells["k", "k"] is None and cells["k", "f"] is None


def test_stars_and_formats(spark):
    df = spark.createDataFrame(
        [(0.0005,), (0.001,), (0.009,), (0.01,), (0.049,), (0.05,), (NAN,), (None,)], "p double"
    )
    got = df.select(significance("p").alias("s"), three_decimals("p").alias("t")).collect()
    assert [r.s for r in got] == ["***", "**", "**", "*", "*", "ns", "ns", "ns"]
    assert [r.t for r in got][-2:] == ["N/A", "N/A"] and got[1].t == "0.001"


def test_add_significance_keeps_columns(spark):
    result = add_significance(correlate_features(outcome_table(spark), "code", ["f"]))
    assert {"significance", "correlation_text", "p_value_text"} <= set(result.columns)


def test_regression_constant_feature(spark):
    lines = regression_line(outcome_table(spark), "code", ["f"], ["source"])
    got = {r.source: r for r in lines.collect()}
    assert got["c"].slope is None and got["b"].slope == pytest.approx(np.polyfit([1, 2, 4], [1, -1, -1], 1)[0])


@pytest.mark.parametrize("parts", [1, 7])
def test_exact_quantiles(spark, parts):
    rng = np.random.default_rng(3)
    third = np.full(1000, 4.25)  # one value holds a third of the rows
    a = np.concatenate([third, rng.normal(size=1000), np.exp(rng.normal(size=1001) * 5)])
    b = np.arange(3001.0)
    df = spark.createDataFrame([(float(x), float(y), None) for x, y in zip(a, b)], "a double, b double, c double")
    got = {r.feature: r for r in describe_features(df.repartition(parts), ["a", "b", "c"]).collect()}
    for name, v in (("a", a), ("b", b)):
        r = got[name]
        assert (r.n, r.lowest, r.highest) == (3001, v.min(), v.max())
        assert r.mean == pytest.approx(v.mean()) and r.std == pytest.approx(v.std(ddof=1))
        assert [r.q25, r.q50, r.q75] == pytest.approx(list(np.quantile(v, [0.25, 0.5, 0.75])), rel=1e-12)
    assert got["c"].n == 0 and got["c"].q50 is None


def test_quantiles_of_tiny_columns(spark):
    for values in ([5.0], [1.0, 2.0], [1.0, 2.0, 4.0, 8.0]):
        df = spark.createDataFrame([(v,) for v in values], "a double")
        r = describe_features(df, ["a"]).first()
        assert [r.q25, r.q50, r.q75] == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.75])))


def test_bootstrap_agrees_with_closed_form(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(1000.0, 1.0, 600)
    y = 0.5 * x + rng.normal(size=600)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))] + [(600, None, 1.0), (601, 1.0, None)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    exact = {r.point: r for r in regression_band(df, "y", ["x"], points=11).collect()}
    drawn = bootstrap_band(df, "id", "y", ["x"], resamples=800, points=11)
    first, again = ({r.point: r for r in d.collect()} for d in (drawn, drawn.repartition(3)))
    for point, e in exact.items():
        d = first[point]
        assert d.fit == pytest.approx(e.fit) and d.x == pytest.approx(e.x)
        assert d.low < e.fit < d.high
        assert d.high - d.low == pytest.approx(e.high - e.low, rel=0.2)
        assert again[point].low == pytest.approx(d.low)


def test_published_p_values():
    # Published r and p per feature, 95 rows.
    published = [
        (-0.00801852759549487, 0.9385268631168612),
        (-0.0344469918720925, 0.7403412988307005),
        (-0.05580523219288835, 0.5911706303540297),
        (-0.07844829743643748, 0.4498513741924563),
        (-0.1285979060679713, 0.21424078801962765),
    ]
    for r, p in published:
        assert pearson_p_value(r, 95) == pytest.approx(p, rel=1e-12)


def test_quantile_in_a_gap(spark):
    low = [k / 1_000_000 for k in range(500)]
    high = [1_000_000 + k / 1_000_000 for k in range(500)]
    df = spark.createDataFrame([(x,) for x in low + high], "a double")
    row = describe_features(df, ["a"]).first()
    assert row.q50 == pytest.approx((low[-1] + high[0]) / 2, rel=1e-15)


def test_quantiles_of_odd_values(spark):
    # Both signs and zeros, the smallest and largest doubles, infinities; NaN counts as missing.
    tiny, huge = 5e-324, 1.7e308
    values = [-math.inf, -huge, -1.5, -tiny, -0.0, 0.0, tiny, 2.0, 2.0, huge, math.inf]
    df = spark.createDataFrame([(v,) for v in [*values, math.nan]], "a double")
    row = describe_features(df, ["a"], quantiles=(0.0, 0.1, 0.3, 0.5, 0.6, 0.7, 1.0)).first()
    got = [row[c] for c in ("q00", "q10", "q30", "q50", "q60", "q70", "q100")]
    assert got == [values[k] for k in (0, 1, 3, 5, 6, 7, 10)] and row.n == 11
    keys = _keys(np.array(values))
    assert (np.diff(keys.astype(object)) >= 0).all() and [_value(int(k)) for k in keys] == values


def test_bootstrap_of_rows_without_values_or_ids(spark):
    rows = [(i, float(i % 5), float(i % 7)) for i in range(200)] + [(None, 1e9, 1e9), (-3, None, 1.0), (-4, 2.0, None)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    band = bootstrap_band(df, "id", "y", ["x"], resamples=50, points=3)
    alone = bootstrap_band(df.where("id >= 0"), "id", "y", ["x"], resamples=50, points=3)
    assert [r.low for r in band.orderBy("point").collect()][0] is not None
    assert [r.high for r in alone.orderBy("point").collect()] != []
