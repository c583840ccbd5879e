import pytest

from dyadlens.operators import cells as C
from dyadlens.operators import scoring

ROW = "model_slot string, model_id string, vignette_id string, gender string, culture string, fault_scroller double, fault_partner double, severity double"


def frame(spark, omit=(), items=3):
    rows = []
    for i in range(items):
        for g, base in (("male", 6), ("female", 4), ("neutral", 5)):
            for c in ("north_american", "south_asian"):
                if (i, g, c) not in omit and (i, g, None) not in omit:
                    rows += [("A", "m", f"V{i}", g, c, float(base + i + k), 1.0, None) for k in (0, 1)]
    return spark.createDataFrame(rows, ROW)


def cells(spark, **k):
    return C.cell_means(frame(spark, **k), ["fault_scroller"], extra=("model_id",))


def test_cells_and_gaps(spark):
    c = cells(spark)
    assert c.count() == 18 and {r.n_runs for r in c.collect()} == {2} and {r.fault_scroller_sd for r in c.collect()} == {0.5}
    assert {r.gap for r in C.paired_gaps(c, "fault_scroller").collect()} == {2.0}


def test_available_and_complete_cases_differ(spark):
    c = cells(spark, omit={(0, "male", "south_asian")})
    g = {r.vignette_id: r for r in C.paired_gaps(c, "fault_scroller").collect()}
    assert g["V0"].gap == 2.0 and g["V0"].gap_b is None and g["V0"].gap_frame_diff is None
    assert {r.vignette_id for r in C.complete_gaps(c, "fault_scroller").collect()} == {"V1", "V2"}
    r = C.completeness(c).first()
    assert (r.n_included, r.n_total, r.n_excluded) == (2, 3, 1)


def test_neutral_counts_only_for_six_cells(spark):
    c = cells(spark, omit={(1, "neutral", None)})
    assert C.completeness(c).first().n_included == 3 and C.completeness(c, levels=("male", "female", "neutral")).first().n_included == 2


def test_missing_level_gives_null_gap(spark):
    g = {r.vignette_id: r.gap for r in C.paired_gaps(cells(spark, omit={(2, "female", None)}), "fault_scroller").collect()}
    assert g["V2"] is None


def test_empty(spark):
    c = C.cell_means(frame(spark, items=0), ["fault_scroller"], extra=("model_id",))
    assert C.paired_gaps(c, "fault_scroller").count() == 0 and C.completeness(c).count() == 0


def test_proportions_and_diffs(spark):
    rows = [("A", "V0", g, c, k) for g in ("male", "female", "neutral") for c in ("north_american", "south_asian") for k in (("x", None) if c == "north_american" else ("x", "x"))]
    df = spark.createDataFrame(rows, "model_slot string, vignette_id string, gender string, culture string, k string")
    p = C.proportions(df, "k", ("x", "y"))
    assert {(r.culture, r.x, r.y) for r in p.collect()} == {("north_american", 0.5, 0.0), ("south_asian", 1.0, 0.0)}
    d = C.category_diffs(p, ("x", "y")).first()
    assert (d.diff_x, d.diff_y) == (-0.5, 0.0)
    assert C.category_diffs(p.where("not (gender = 'male' and culture = 'south_asian')"), ("x", "y")).count() == 0


def test_analysable_ignores_severity(spark):
    df = spark.createDataFrame([(True, "", 1.0, 2.0, None), (True, "severity", 1.0, 2.0, None), (None, "", 1.0, 2.0, 3.0), (True, None, None, 2.0, 3.0)], "parse_ok boolean, missing_keys string, fault_scroller double, fault_partner double, severity double")
    assert scoring.analysable(df).count() == 1


@pytest.mark.parametrize("name", ["first", "second"])
def test_extra_columns_with_clashing_names(spark, name):
    f = frame(spark).selectExpr("*", f"1 as {name}", "2 as gap")
    g = C.paired_gaps(C.cell_means(f, ["fault_scroller"]), "fault_scroller")
    assert {r.gap for r in g.collect()} == {2.0}
