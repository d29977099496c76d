"""Registered volatility queries forecast every series and every day."""

import pytest

from tidemark.config import Config
from tidemark.operators import garch, report, sv
from tidemark.plans import catalog


def _days(df):
    return {(r.series_id, r.t) for r in df.select("series_id", "t").distinct().collect()}


@pytest.mark.parametrize("name", ["sv_gaussian", "sv_t", "sv_leverage", "sv_t_leverage", "sv_posterior_histogram"])
def test_volatility_takes_every_series(spark, sf, monkeypatch, name):
    seen = []

    def kept(returns, variant, c, s=sv.Sampler()):
        seen.append((_days(returns), c.window, c.refit_every, s))
        return returns

    monkeypatch.setattr(sv, "forecasts", kept)
    monkeypatch.setattr(sv, "posterior", kept)
    monkeypatch.setattr(sv, "long_draws", lambda df, *a: df)
    monkeypatch.setattr(report, "histogram", lambda df, *a: df)
    catalog.QUERIES[name](spark, sf)
    assert seen == [(_days(catalog.QUERIES["log_returns"](spark, sf)), 250, Config().refit_every, sv.Sampler())]


def test_posteriors_are_told_apart(spark, sf, monkeypatch):
    """A histogram is of one fit's draws."""
    made = sv.posterior
    monkeypatch.setattr(sv, "posterior", lambda r, v, c: made(r.where("series_id = '1-URGENT' and t <= 300"), v, c, sv.Sampler(40, 40)))
    got = catalog.QUERIES["sv_posterior_histogram"](spark, "/root/testdata/sf0.01").toPandas()
    assert set(got["refit_t"]) == {251, 293} and set(got["parameter"]) == {"phi", "sigma", "nu"}


@pytest.mark.parametrize("name", ["garch_fit", "egarch_fit"])
def test_garch_takes_every_day(spark, monkeypatch, name):
    sf = "/root/testdata/sf0.01"
    monkeypatch.setattr(garch, "forecasts", lambda returns, *a, **b: returns)
    got = _days(catalog.QUERIES[name](spark, sf))
    assert got == _days(catalog.QUERIES["log_returns"](spark, sf)) and max(t for _, t in got) > 450
