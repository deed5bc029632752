"""The published correlations, from the published result tables.

The tables are not part of this repository: VERSEFLUX_TEXT_RESULTS and
VERSEFLUX_SIGNAL_RESULTS name the two CSV files.
"""

import os

import pytest

from verseflux.functions.fixed import SIGNAL_FEATURES
from verseflux.plans.correlation import (
    chart_tables,
    correlation_report,
    group_report,
    joined_table,
    load_results,
    overall,
)

TEXTS = os.environ.get("VERSEFLUX_TEXT_RESULTS")
SIGNALS = os.environ.get("VERSEFLUX_SIGNAL_RESULTS")
pytestmark = pytest.mark.skipif(not (TEXTS and SIGNALS), reason="published tables not given")

# Published r and p per feature, 95 joined rows, in order of r.
PUBLISHED = {
    "vocal_tone_quality": (-0.00801852759549487, 0.9385268631168612),
    "musical_note_strength": (-0.0344469918720925, 0.7403412988307005),
    "sound_brightness": (-0.05580523219288835, 0.5911706303540297),
    "sound_loudness": (-0.07844829743643748, 0.4498513741924563),
    "tempo": (-0.1285979060679712, 0.21424078801962765),
}


@pytest.fixture(scope="module")
def tables(spark):
    return load_results(spark, TEXTS, SIGNALS)


def check(rows):
    assert [r.feature for r in rows] == list(PUBLISHED)
    for r in rows:
        assert r.sample_size == 95
        assert r.correlation == pytest.approx(PUBLISHED[r.feature][0], abs=1e-12)
        assert r.p_value == pytest.approx(PUBLISHED[r.feature][1], abs=1e-12)


def test_report_without_join(tables):
    rows = correlation_report(*tables).collect()
    check(rows)
    assert {r.significance for r in rows} == {"ns"} and rows[-1].correlation_text == "-0.129"


def test_report_with_join(tables):
    check(overall(joined_table(*tables)).collect())


def test_one_feature_row_per_title(tables):
    rows = {r.feature: r for r in correlation_report(*tables, dedupe_right=True).collect()}
    assert rows["tempo"].sample_size == 93
    assert rows["tempo"].correlation == pytest.approx(-0.12802, abs=1e-5)
    assert overall(joined_table(*tables, dedupe_right=True)).first().sample_size == 93


def test_charts_and_groups(tables):
    joined = joined_table(*tables)
    charts = chart_tables(joined)
    assert charts.points.count() == 95 * 5
    assert charts.bands.count() == 500 and charts.lines.count() == 5
    cells = {(r.feature_a, r.feature_b): r.correlation for r in charts.matrix.collect()}
    assert len(cells) == 36
    for f in SIGNAL_FEATURES:
        assert cells["sentiment_numeric", f] == pytest.approx(PUBLISHED[f][0], abs=1e-12)
    notes = {r.feature: r.annotation for r in charts.annotations.collect()}
    assert notes["tempo"] == "Correlation: -0.13"
    wide = group_report(joined, groups=["human"]).collect()
    assert {r.feature: r.human_correlation for r in wide}["tempo"] == pytest.approx(PUBLISHED["tempo"][0])
