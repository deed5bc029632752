"""Merged moments against one pass over all rows, stored moments of a stream, density grids."""

import pytest

from verseflux.operators.charts import density_grid
from verseflux.operators.correlate import correlate_features
from verseflux.operators.moments import correlate_moments, feature_moments, merge_moments
from verseflux.streaming.correlations import follow_correlations, stored_correlations

NAN = float("nan")
SCHEMA = "g string, y double, z double, a double, b double"


def some_rows(spark, n=60):
    rows = []
    for i in range(n):
        g = (None, "u", "flat")[i % 3]
        y = 1.0 if g == "flat" else 1e6 + (i * 37 % 11)
        a = NAN if i == 5 else None if i == 7 else float(i * 13 % 17)
        rows.append((g, y, float(i % 7), a, 1e6 + 0.5 * (i * 29 % 23)))
    return spark.createDataFrame(rows, SCHEMA)


def same(left, right):
    left, right = left.collect(), right.collect()
    key = lambda r: (r.g or "", r.feature)
    assert len(left) == len(right) and left[0].asDict().keys() == right[0].asDict().keys()
    for one, two in zip(sorted(left, key=key), sorted(right, key=key), strict=True):
        for name, x in one.asDict().items():
            y = two[name]
            assert x == (pytest.approx(y, abs=1e-9) if isinstance(y, float) else y), (name, one, two)


@pytest.mark.parametrize("policy", ["propagate", "pairwise"])
@pytest.mark.parametrize("fallback", [None, "z"])
def test_merged_moments_equal_one_pass(spark, policy, fallback):
    df = some_rows(spark)
    parts = [df.where(f"b % 3 < {n + 1} AND b % 3 >= {n}") for n in range(3)]
    stored = feature_moments(parts[0], ["y", "z"], ["a", "b"], ["g"])
    for part in parts[1:]:
        stored = stored.union(feature_moments(part, ["y", "z"], ["a", "b"], ["g"]))
    whole = correlate_features(df, "y", ["a", "b"], fallback, ["g"], policy)
    same(correlate_moments(stored, "y", fallback, ["g"], policy), whole)


def test_merging_twice_is_merging_once(spark):
    df = some_rows(spark)
    parts = [feature_moments(df.where(c), ["y"], ["a", "b"]) for c in ("z < 2", "z BETWEEN 2 AND 4", "z > 4")]
    once = merge_moments(parts[0].union(parts[1]).union(parts[2])).orderBy("feature").collect()
    half = merge_moments(parts[0].union(parts[1])).select(*parts[2].columns)
    for one, two in zip(once, merge_moments(half.union(parts[2])).orderBy("feature").collect(), strict=True):
        assert all(one[c] == (two[c] if isinstance(two[c], str) else pytest.approx(two[c])) for c in one.asDict())


def test_empty_and_single_rows(spark):
    df = some_rows(spark)
    none = feature_moments(df.where("false"), ["y"], ["a"])
    row = correlate_moments(none, "y").first()
    assert (row.sample_size, row.correlation, row.p_value) == (0, None, None)
    assert feature_moments(df.where("false"), ["y"], ["a"], ["g"]).isEmpty()
    alone = feature_moments(df.limit(1), ["y"], ["a"])
    assert correlate_moments(alone, "y").first().correlation is None
    with pytest.raises(ValueError):
        correlate_moments(none, "y", null_policy="other")


def test_increments_of_a_stream_equal_the_full_run(spark, tmp_path):
    source, store, state = (str(tmp_path / n) for n in ("rows", "moments", "state"))
    df = some_rows(spark)

    def follow():
        stream = spark.readStream.schema(df.schema).parquet(source)
        assert follow_correlations(stream, store, state, ["y", "z"], ["a", "b"], ["g"]).awaitTermination(120)

    df.where("z < 3").write.parquet(source)
    follow()
    same(
        stored_correlations(spark, store, "y", "z", ["g"]),
        correlate_features(df.where("z < 3"), "y", ["a", "b"], "z", ["g"]),
    )
    df.where("z >= 3").write.mode("append").parquet(source)
    follow()
    whole = correlate_features(df, "y", ["a", "b"], "z", ["g"])
    same(stored_correlations(spark, store, "y", "z", ["g"]), whole)
    follow()  # nothing new
    same(stored_correlations(spark, store, "y", "z", ["g"]), whole)


def test_density_grid(spark):
    rows = [(float(i), float(i % 4), 5.0) for i in range(8)]
    rows += [(None, 1.0, 5.0), (NAN, 1.0, 5.0), (3.0, None, 5.0), (float("inf"), 1.0, 5.0)]
    cells = density_grid(spark.createDataFrame(rows, "x double, y double, c double"), "y", ["x", "c"], 2).collect()
    x = {(r.x_bin, r.y_bin): r.points for r in cells if r.feature == "x"}
    # x spans 0 to 7, halves at 3.5; y spans 0 to 3, halves at 1.5.
    assert x == {(0, 0): 2, (0, 1): 2, (1, 0): 2, (1, 1): 2}
    c = {(r.x_bin, r.y_bin): (r.points, r.x_from, r.x_to) for r in cells if r.feature == "c"}
    assert c == {(0, 0): (7, 5.0, 5.0), (0, 1): (4, 5.0, 5.0)}
    assert next((r.x_from, r.x_to, r.y_from, r.y_to) for r in cells if r.feature == "x" and (r.x_bin, r.y_bin) == (1, 0)) == (3.5, 7.0, 0.0, 1.5)


def test_density_grid_without_points(spark):
    empty = spark.createDataFrame([], "x double, y double")
    assert density_grid(empty, "y", ["x"]).isEmpty()
    with pytest.raises(ValueError):
        density_grid(empty, "y", ["x"], 0)
