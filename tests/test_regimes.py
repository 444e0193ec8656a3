import pytest

from tidebar.operators import regimes

COLUMNS = "ema_order double, swing double, momentum double, volume double, parent_regime string, prior string"


@pytest.mark.parametrize(
    "row, state",
    [
        ((1.0, 1.0, 1.0, 1.0, None, None), "bullish"),
        ((1.0, 0.2, 0.0, 0.0, None, None), "bullish"),
        ((1.0, 0.0, 0.0, 0.0, None, None), "neutral"),
        ((1.0, 0.0, 0.0, 0.0, None, "bullish"), "transition_down"),
        ((-1.0, 0.0, 0.0, 0.0, None, "bearish"), "transition_up"),
        ((1.0, 1.0, 1.0, 1.0, "bearish", None), "transition_up"),
        ((-1.0, -1.0, -1.0, 0.0, "bullish", None), "transition_down"),
        ((-1.0, -1.0, 0.0, 0.0, "bearish", None), "bearish"),
    ],
)
def test_weighted_scores_with_hysteresis(spark, row, state):
    assert regimes.regime_scores(spark.createDataFrame([row], COLUMNS)).first().state == state


def test_states_do_not_look_ahead(spark):
    from pyspark.sql import functions as F

    from tidebar.operators.resample import visible
    from tidebar.sources.bars import bars_from_events

    bars, cut = bars_from_events(spark, "/root/testdata/sf0.01", 60), 1705276800
    changed = visible(bars, 60, cut).unionByName(bars.where(F.col("t") > cut - 3600).withColumns({c: F.col(c) * 9 for c in "ohlc"}))
    key = lambda b: sorted((tuple(r) for r in regimes.states_in_context(b, 60, {"4h": 240}).where(f"t <= {cut - 3600}").collect()), key=str)
    assert key(bars) == key(changed)
