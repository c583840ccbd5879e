"""Registered resampling queries draw as often as the analysis does."""

import inspect

import pytest

from dyadlens.operators import stats
from dyadlens.plans import catalog


@pytest.mark.parametrize(("name", "function"), [("tp_permutation", "permutation_test"), ("tb_poisson", "poisson_ci"), ("tb_bootstrap", "bootstrap_ci")])
def test_ten_thousand_resamples(monkeypatch, name, function):
    shape = inspect.signature(getattr(stats, function))
    monkeypatch.setattr(catalog, "_gaps", lambda s, d: None)
    monkeypatch.setattr(catalog, "_diffs", lambda s, d: None)
    monkeypatch.setattr(catalog, "_round6", lambda df, *_: df)

    def drawn(*a, **k):
        bound = shape.bind(*a, **k)
        bound.apply_defaults()
        return bound.arguments["resamples"]

    monkeypatch.setattr(stats, function, drawn)
    assert catalog.queries()[name](None, "") == 10_000
