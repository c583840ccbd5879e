"""What is written at the end of a collection: manifest, the inputs it was frozen with, agreement and status."""

from __future__ import annotations

import datetime
import hashlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import stats, validation
from .protocol import Protocol
from .schemas import CATEGORIES
from .sources import files

PAIRS = (("coder_a", "coder_b"), ("coder_a", "automated"), ("coder_b", "automated"))


def digest(path: str) -> str:
    """sha256 of a file, read in pieces."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def freeze(spark: SparkSession, raw: str, protocol_path: str, items_path: str, protocol: Protocol, out: str) -> dict:
    """The manifest of the raw folder and, beside it, what it was made of. Returns the latter.

    The collection must be complete and the protocol locked, else nothing is written (see validation.release_gate).
    """
    content = files.binary(spark, raw).where(F.col("path").endswith(".json"))
    listed = validation.manifest(content).persist()
    try:
        n = listed.count()
        state = validation.release_gate(n, protocol.target, protocol.locked)
        if state != "ready":
            return {"state": state, "responses": n, "expected": protocol.target}
        files.write_manifest(listed, f"{out}/raw_sha256")
        # one number for all lines, in any order: no list of digests is gathered
        whole = listed.agg(F.hex(F.bit_xor(F.xxhash64("path", "sha256")))).first()[0]
    finally:
        listed.unpersist()
    inputs = {
        "state": state, "frozen_at_utc": datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "responses": n, "expected": protocol.target,
        "items": {"path": items_path, "sha256": digest(items_path)}, "protocol": {"path": protocol_path, "sha256": digest(protocol_path), "locked": protocol.locked},
        "manifest": {"path": f"{out}/raw_sha256", "lines_xor": whole},
    }
    files.write_json(inputs, f"{out}/inputs.json")
    return inputs


def agreement(matched: DataFrame) -> dict:
    """K6: exact agreement and kappa of each pair of annotators."""
    got = {f"{a}-{b}": stats.kappa(matched, a, b, CATEGORIES).first().asDict() for a, b in PAIRS}
    return {"categories": list(CATEGORIES), "pairs": got}


def agreement_text(summary: dict) -> str:
    """K6: the same as Markdown; the coders' own agreement first, the classifier's for reference."""
    lines = ["# Agreement of the validation sample"]
    for i, (name, r) in enumerate(summary["pairs"].items()):
        if i < 2:
            lines += ["", "## Between the coders" if i == 0 else "## With the classifier, for reference only", ""]
        share = "n/a" if not r["n"] else f"{r['exact'] / r['n']:.1%}"
        kappa = "n/a" if r["kappa"] is None else f"{r['kappa']:.3f}"
        lines.append(f"- {name}: {r['exact']} of {r['n']} the same ({share}), kappa {kappa}")
    return "\n".join(lines) + "\n"


def coded(sheets: dict[str, DataFrame], rows: int = validation.SAMPLE) -> tuple[bool, int, list[str]]:
    """(whether every sheet is wholly and rightly filled, labels of the slower coder, what is wrong)."""
    problems, counts = [], []
    for name, sheet in sheets.items():
        found = validation.worksheet_problems(sheet, rows=rows).orderBy("problem", "sample_id").limit(50).collect()
        problems += [f"{name}: {r['problem']} {r['sample_id'] or ''} ({r['n']})" for r in found]
        counts.append(sheet.where(F.trim(F.coalesce("action_category", F.lit(""))) != "").count())
    return not problems, min(counts, default=0), problems


def status_text(inputs: dict, ready: bool, n_coded: int, problems: list[str], rows: int = validation.SAMPLE) -> str:
    """How far the release is."""
    lines = ["# Status", "", f"- Collection: {inputs['responses']} of {inputs['expected']}", f"- Validation: {n_coded} of {rows} labelled", f"- Release: {'ready' if ready and inputs['state'] == 'ready' else 'waiting'}"]
    return "\n".join([*lines, *(["", "Notes:", *(f"- {p}" for p in problems)] if problems else [])]) + "\n"


def write(path: str, text: str) -> None:
    """A small text, its folder made if need be."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")
