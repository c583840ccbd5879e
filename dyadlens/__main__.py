"""Command line: python -m dyadlens plan|score|analyze|control|sample|agreement|finalize|compact ... (see --help of each).

Exit codes: 0 done (or nothing to do), 1 a check failed, 2 a missing file or an empty plan, 3 the protocol isn't locked,
4 a slot has no model.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import protocol, release, report
from .analysis import Analysis
from .operators import compaction, design, scoring, stats, validation
from .schemas import CATEGORIES
from .session import local_session
from .sources import files

KEYS = ("vignette_id", "model_slot", "gender", "culture", "run_index")


class Stop(Exception):
    """Ends the command with a message and an exit code."""

    def __init__(self, message: str, code: int = 2) -> None:
        super().__init__(message)
        self.code = code


def read(spark: SparkSession, path: str) -> DataFrame:
    """A scored table: CSV by its name, else Parquet."""
    return files.scored_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path)


def plan(spark: SparkSession, a: argparse.Namespace) -> None:
    """The tasks of the protocol that have no record yet, in the plan's order; with --out written, else counted and shown."""
    p = protocol.read(a.config)
    slots = {s.upper() for s in a.model or ()}
    models = [m for m in p.models if not slots or m[0].upper() in slots]
    items = files.items(spark, a.items or p.paths.get("vignettes", ""))
    tasks = design.grid(items, models, p.runs, p.genders, p.cultures) if models else None
    if tasks is None or tasks.isEmpty():
        raise Stop("the plan is empty; check --model and the protocol")
    todo = design.pending(tasks, spark.read.parquet(a.cached).select(*KEYS), KEYS) if a.cached else tasks
    total, left = tasks.count(), todo.count()
    print(f"{total} planned, {total - left} cached, {left} pending")
    first = design.first_pending(todo, a.limit) if a.limit is not None else todo
    if a.dry_run:
        design.first_pending(todo, a.limit or 5).select(*KEYS).show(a.limit or 5, False)
        return
    if not p.locked and not a.allow_unlocked:
        raise Stop("the protocol is not locked; --allow-unlocked is for trials only", 3)
    if open_slots := [x for x in p.unfilled() if x in {m[0] for m in models}]:
        raise Stop(f"no model is named for slot {', '.join(open_slots)}", 4)
    if a.out:
        design.with_keys(first, p.template, p.system, design.of_slot(p.efforts), design.of_slot(p.forms)).write.mode("overwrite").parquet(a.out)
    else:
        first.select(*KEYS).show(20, False)


def score(spark: SparkSession, a: argparse.Namespace) -> None:
    rec, unreadable = files.responses(spark, a.raw)
    files.write_scored(scoring.score(rec), a.out, csv=a.out.endswith(".csv"))
    if n := unreadable.count():
        print(f"{n} unreadable files were passed over", file=sys.stderr)


def analyze(spark: SparkSession, a: argparse.Namespace) -> None:
    p = protocol.read(a.config) if a.config else protocol.Protocol()
    with Analysis(read(spark, a.scored), p.design, seed=p.seed, resamples=a.resamples or p.resamples) as analysis:
        release.write(a.out, report.results(analysis.sections()))


def control(spark: SparkSession, a: argparse.Namespace) -> None:
    checks = validation.control_checks(read(spark, a.scored), files.lookup(spark, a.key, "id string, pass_criterion string"))
    files.write_table(checks, a.out)
    files.write_json({"summary": [r.asDict() for r in validation.control_summary(checks).collect()]}, f"{a.out}.json")


def sample(spark: SparkSession, a: argparse.Namespace) -> None:
    """Q1, Q2, K4: two worksheets and their key; left alone once a coder has begun."""
    for name in ("coder_a", "coder_b"):
        if Path(f"{a.out}/{name}").exists() and validation.filled(files.text_csv(spark, f"{a.out}/{name}")):
            print(f"{a.out}/{name} has labels already; nothing is written")
            return
    scored = read(spark, a.scored)
    drawn = validation.seeded_sample(scoring.scorable(scored))
    if drawn.isEmpty():
        print("no row can be sampled")
        return
    sheet, key = validation.worksheets(drawn.join(scored.dropDuplicates(["cache_key"]).drop("model_slot"), "cache_key"))
    for name, df in (("coder_a", sheet), ("coder_b", sheet), ("key", key)):
        files.write_table(df.orderBy("sample_id"), f"{a.out}/{name}")


def agreement(spark: SparkSession, a: argparse.Namespace) -> None:
    sheets = [files.text_csv(spark, x) for x in (a.a, a.b, a.key)]
    for name, sheet in (("coder_a", sheets[0]), ("coder_b", sheets[1])):
        wrong = [r for r in validation.worksheet_problems(sheet, rows=a.rows).limit(5).collect() if r["problem"] != "repeated"]
        if wrong:
            raise Stop(f"{name}: {', '.join(f'{r.problem} {r.sample_id}' for r in wrong)}", 1)
    m = validation.matched_labels(*sheets, expected=a.rows).persist()
    for x, y in release.PAIRS:
        files.write_table(stats.confusion(m, x, y, CATEGORIES).withColumnRenamed("row", f"{x}\\{y}"), f"{a.out}/confusion_{x}_{y}")
    summary = release.agreement(m)
    files.write_json(summary, f"{a.out}/summary.json")
    release.write(f"{a.out}/summary.md", release.agreement_text(summary))
    m.unpersist()


def finalize(spark: SparkSession, a: argparse.Namespace) -> None:
    p = protocol.read(a.config)
    try:
        inputs = release.freeze(spark, a.raw, a.config, a.items, p, a.out)
    except ValueError as e:
        raise Stop(str(e), 1) from e
    sheets = {n: files.text_csv(spark, path) for n, path in (("coder_a", a.a), ("coder_b", a.b)) if path and Path(path).exists()}
    ready, n, problems = release.coded(sheets) if len(sheets) == 2 else (False, 0, ["a worksheet does not exist"])
    release.write(f"{a.out}/STATUS.md", release.status_text(inputs, ready, n, problems))


def compact(spark: SparkSession, a: argparse.Namespace) -> None:
    compaction.compact(spark.read.parquet(a.files), a.out, a.target_bytes).show(20, False)


COMMANDS = {f.__name__: f for f in (plan, score, analyze, control, sample, agreement, finalize, compact)}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="dyadlens")
    sub = p.add_subparsers(dest="what", required=True)

    def command(name: str, *needed: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=(COMMANDS[name].__doc__ or "").split("\n")[0] or None)
        for o in needed:
            c.add_argument(f"--{o}", required=True)
        return c

    c = command("plan", "config")
    for o in ("items", "cached", "out"):
        c.add_argument(f"--{o}")
    c.add_argument("--limit", type=int)
    c.add_argument("--model", action="append")
    c.add_argument("--dry-run", action="store_true")
    c.add_argument("--allow-unlocked", action="store_true")
    command("score", "raw", "out")
    c = command("analyze", "scored", "out")
    c.add_argument("--config")
    c.add_argument("--resamples", type=int)
    command("control", "scored", "key", "out")
    command("sample", "scored", "out")
    command("agreement", "a", "b", "key", "out").add_argument("--rows", type=int, default=validation.SAMPLE)
    c = command("finalize", "config", "raw", "items", "out")
    c.add_argument("--a")
    c.add_argument("--b")
    command("compact", "files", "out").add_argument("--target-bytes", type=int, default=128 << 20)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        COMMANDS[a.what](local_session("*"), a)
    except (Stop, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return getattr(e, "code", 2)
    return 0


if __name__ == "__main__":
    sys.exit(main())
