"""The command line end to end over small files: exit codes, guards, what is written."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from dyadlens import __main__ as cli
from dyadlens import protocol, release, report
from dyadlens.functions import expressions as X
from dyadlens.schemas import CATEGORIES

PROTOCOL = """
locked: {locked}
design: {{factors: {{gender: [male, female, neutral], culture: [east, west]}}, runs_per_cell: 2, total_calls: {target}, seed: 5}}
models: [{{slot: A, id: m/a, reasoning_effort: low}}, {{slot: B, id: m/b}}]
prompts: {{system: Judge., user_template: "Story: {{vignette}}"}}
statistics: {{alpha: 0.1, confidence_intervals: {{resamples: 300, level: 0.9}}}}
"""


@pytest.fixture
def root(tmp_path, spark, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda _: spark)
    (tmp_path / "items.jsonl").write_text(json.dumps({"id": "V1", "distress": False, "variants": {f"{g}_{c}": f"{g} in the {c}" for g in ("male", "female", "neutral") for c in ("east", "west")}}) + "\n")
    (tmp_path / "p.yaml").write_text(PROTOCOL.format(locked="true", target=2))
    (tmp_path / "open.yaml").write_text(PROTOCOL.format(locked="false", target=2))
    return tmp_path


def test_protocol_gives_the_parameters(root):
    p = protocol.read(str(root / "p.yaml"))
    assert (p.locked, p.models, p.runs, p.target, p.seed, p.alpha, p.resamples, p.level, p.daily_cap) == (True, (("A", "m/a"), ("B", "m/b")), 2, 2, 5, 0.1, 300, 0.9, 175)
    assert p.design.frame_a == "east" and p.design.first == "male" and p.efforts == {"A": "low", "B": None}


def test_plan(root, spark, capsys):
    args = ["plan", "--config", f"{root}/p.yaml", "--items", f"{root}/items.jsonl"]
    assert cli.main([*args, "--dry-run"]) == 0 and "24 planned, 0 cached, 24 pending" in capsys.readouterr().out
    assert cli.main([*args, "--model", "a", "--limit", "5", "--out", f"{root}/tasks"]) == 0
    tasks = spark.read.parquet(f"{root}/tasks")
    assert tasks.count() == 5 and {r.model_slot for r in tasks.collect()} == {"A"} and tasks.first().user_prompt == "Story: male in the east" and len(tasks.first().cache_key) == 64
    assert cli.main([*args, "--cached", f"{root}/tasks", "--dry-run"]) == 0 and "5 cached, 19 pending" in capsys.readouterr().out
    assert cli.main([*args, "--model", "Z"]) == 2 and cli.main(["plan", "--config", f"{root}/none.yaml"]) == 2
    assert cli.main(["plan", "--config", f"{root}/open.yaml", "--items", f"{root}/items.jsonl"]) == 3
    (root / "tbd.yaml").write_text((root / "p.yaml").read_text().replace("m/b", "TBD"))
    tbd = ["plan", "--config", f"{root}/tbd.yaml", "--items", f"{root}/items.jsonl"]
    assert cli.main(tbd) == 4 and cli.main([*tbd, "--model", "A"]) == 0


def scored(spark, root):
    rows = [(f"k{i}", "AB"[i % 2], "m", f"V{i % 5}", ("male", "female", "neutral")[i % 3], "east", "male_east", i, True, "", 5.0, 3.0, "Talk.", "negotiate") for i in range(120)]
    df = spark.createDataFrame(rows, "cache_key string, model_slot string, model_id string, vignette_id string, gender string, culture string, variant string, run_index int, parse_ok boolean, missing_keys string, fault_scroller double, fault_partner double, recommended_action string, action_category string")
    df.write.parquet(f"{root}/scored")


def fill(folder, labels):
    (path,) = folder.glob("*.csv")
    rows = list(csv.DictReader(path.open()))
    for i, r in enumerate(rows):
        r["action_category"] = labels[i % len(labels)]
    with path.open("w", newline="") as f:
        w = csv.DictWriter(f, rows[0])
        w.writeheader()
        w.writerows(rows)
    for crc in folder.glob(".*.crc"):
        crc.unlink()


def test_sample_is_not_written_over_and_agreement(root, spark, capsys):
    scored(spark, root)
    sample = ["sample", "--scored", f"{root}/scored", "--out", f"{root}/mv"]
    agreement = ["agreement", "--a", f"{root}/mv/coder_a", "--b", f"{root}/mv/coder_b", "--key", f"{root}/mv/key", "--out", f"{root}/agreed"]
    assert cli.main(sample) == 0 and cli.main(sample) == 0
    assert cli.main(agreement) == 1  # nothing is filled in
    fill(root / "mv/coder_a", ["negotiate", "boundary"])
    before = (root / "mv/coder_a").stat().st_mtime_ns
    capsys.readouterr()
    assert cli.main(sample) == 0 and "has labels" in capsys.readouterr().out and (root / "mv/coder_a").stat().st_mtime_ns == before
    fill(root / "mv/coder_b", ["negotiate"])
    assert cli.main(agreement) == 0
    got = json.loads((root / "agreed/summary.json").read_text())["pairs"]
    assert (got["coder_a-coder_b"]["n"], got["coder_a-coder_b"]["exact"], got["coder_b-automated"]["kappa"]) == (50, 25, 1.0)
    assert "25 of 50 the same (50.0%)" in (root / "agreed/summary.md").read_text()
    (table,) = (root / "agreed/confusion_coder_a_coder_b").glob("*.csv")
    assert table.read_text().splitlines()[0].replace('"', "").replace("\\\\", "\\") == "coder_a\\coder_b," + ",".join(CATEGORIES)
    assert cli.main([*agreement, "--rows", "49"]) == 1


def test_finalize(root, spark):
    (root / "raw").mkdir()
    args = ["finalize", "--config", f"{root}/p.yaml", "--raw", f"{root}/raw", "--items", f"{root}/items.jsonl", "--out", f"{root}/final"]
    (root / "raw/a.json").write_text("{}")
    assert cli.main(args) == 0 and not (root / "final/inputs.json").exists() and "1 of 2" in (root / "final/STATUS.md").read_text()
    (root / "raw/b.json").write_text("{ }")
    assert cli.main(args) == 0
    inputs = json.loads((root / "final/inputs.json").read_text())
    assert inputs["responses"] == 2 and inputs["items"]["sha256"] == release.digest(f"{root}/items.jsonl")
    lines = [x for f in sorted((root / "final/raw_sha256").glob("part*")) for x in f.read_text().splitlines()]
    assert [x.split("/")[-1] for x in lines] == ["a.json", "b.json"] and lines[0].startswith(release.digest(f"{root}/raw/a.json") + "  ")
    assert "waiting" in (root / "final/STATUS.md").read_text()
    assert cli.main([args[0], args[1], f"{root}/open.yaml", *args[3:]]) == 1
    (root / "raw/c.json").write_text("{}")
    assert cli.main(args) == 1  # more than the design has


def test_registered_functions(spark):
    assert X.register(spark) == ["normalise_text", "extract_json"]
    r = spark.sql("""SELECT normalise_text('Ａ  b') AS n, extract_json('so: {"a": 1}') AS x, extract_json(NULL) AS y""").first()
    assert r.n == "a b" and (r.x.status, r.x.object) == ("embedded", '{"a": 1}') and r.y.status == "unparseable"


def test_whole_documents_only(spark):
    texts = ['{"a": 1}', '{"a": 1} x', "[1]", '{"a": "}"}', '{"a": NaN}', None, "", '{"a": {"b": [1, {"c": 2}]}}', '{"a": 1}}', "{}", "{ }", '{} {"a": 1}', '{"a": 1} {}', "{,}", '{"a": 1,}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [bool(r[0]) for r in df.select(F.coalesce(X.whole_object(F.col("t")), F.lit(False))).collect()] == [True, False, False, True, True, False, False, True, False, True, True, False, False, False, False]


def test_histogram_drawing():
    svg = report.histogram_svg([(-1.0, 0.0, 2), (0.0, 1.0, 4)], "gaps & more")
    assert svg.count("<rect") == 2 and 'height="100.0"' in svg and "gaps &amp; more" in svg and 'x1="240.0"' in svg
    assert "<rect" not in report.histogram_svg([], "none")
