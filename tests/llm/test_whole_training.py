"""Problem 3's weights and thresholds come from all distinct responses, as vectors with counts."""

import numpy as np

from dyadlens.llm import cutoff
from dyadlens.llm.endings import endings_of


def test_every_distinct_response_is_trained_on(spark, monkeypatch):
    texts = [f"Case {i}: the partner who kept scrolling carries more of it." for i in range(15_000)]
    rows = [(t, "stop", 100, "Dana tuned the cello.") for t in [*texts, *texts[:500], None, " "]]
    df = spark.createDataFrame(rows, "t string, f string, n long, story string").repartition(4)
    given, train = [], cutoff.train
    monkeypatch.setattr(cutoff, "train", lambda data, times=None, fold=None: given.append(len(data) if times is None else sum(times)) or train(data[:40]))
    endings = cutoff.model_of(df)[2]
    assert given == [sum(1 for r in rows[:15_000] for _ in cutoff.examples(*r, endings))]


def test_one_fold_a_response_and_one_count_a_copy(spark):
    texts = [f"Case {i}: they both share it. Dana might as well ask." for i in range(40)]
    df = spark.createDataFrame([(t, "stop", 100, None) for t in texts * 3], "t string, f string, n long, story string")
    got = cutoff.counted_examples(df, endings_of(df.select("t")), 1).collect()
    assert {r.fold for r in got} == set(range(cutoff.FOLDS))
    assert sum(r.n for r in got if not r.vector[1]) == 40  # each is one piece of prose


def test_counts_stand_for_repeated_vectors():
    rng = np.random.default_rng(3)
    x, n = rng.integers(0, 30, (60, 4)), rng.integers(1, 9, 60)
    y = (rng.random(60) < 0.4).astype(float)
    again = np.repeat(np.arange(60), n)
    w = cutoff.fit(x, y, n.astype(float))
    assert np.allclose(w, cutoff.fit(x[again], y[again], np.ones(len(again))), atol=1e-3)
    z = w[x].sum(1)
    for share in (0, 0.3, 0.9994, 1):
        assert np.isclose(cutoff.quantile(z, n, share), np.quantile(z[again], share))
