"""A published bundle: inputs that must be there, tables, a manifest, a summary for readers, and checksums of every file.

All counts come from small aggregates (`stats`); only they reach the driver, never rows of samples.
"""

from __future__ import annotations

import json
import string
import subprocess
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import integrity, stats
from ..sources.reports import there
from .writers import replaced

MANIFEST, SUMMARY, CHECKSUMS = "manifest.json", "README.md", "CHECKSUMS.sha256"
NONE = "—"


class _Known(string.Formatter):
    """Fills a text from a report; what the report does not have shows as a dash."""

    def get_field(self, name, args, kwargs):
        value = kwargs
        for key in name.split("."):
            value = value.get(key) if isinstance(value, Mapping) else None
        return value, name

    def format_field(self, value, spec):
        return NONE if value is None else super().format_field(value, spec)


@dataclass(frozen=True)
class Stage:
    """A row of the summary's table of stages: what went in, what came out, what is known of its error. Each is a text with
    fields of the stage's report, as `{n_tracks}` or `{gold.rate:.1%}`."""

    name: str
    took: str
    gave: str
    known: str = NONE


def require(spark: SparkSession, paths: Iterable[str]) -> None:
    """All inputs that are missing are named in one error."""
    gone = [p for p in paths if not there(spark, p)]
    if gone:
        raise FileNotFoundError("missing inputs: " + ", ".join(gone))


def revision(folder: str) -> dict:
    """Commit of the working tree, and whether it had changes; nulls where there is no repository. Changes are noted, not refused."""

    def ask(*words: str) -> str | None:
        done = subprocess.run(["git", "-C", folder, *words], capture_output=True, text=True, check=False)
        return done.stdout.strip() if done.returncode == 0 else None

    changed = ask("status", "--porcelain")
    return {"commit": ask("rev-parse", "HEAD"), "dirty": None if changed is None else changed != ""}


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def manifest(index: DataFrame, version: str, funnel: DataFrame, stages: Mapping[str, Mapping], skips: DataFrame, source: Mapping | None = None, created: str | None = None, **more) -> dict:
    """What the bundle is and what it holds: version, revision, funnel, stages, skips, and the composition at every horizon."""
    composition: dict = {}
    for row in _rows(stats.composition_at(index).orderBy("horizon", F.desc("level"), "tier", "split")):
        composition.setdefault(row.pop("horizon"), []).append(row)
    return {
        "version": version,
        "created": created or datetime.now(UTC).isoformat(timespec="seconds"),
        "source": dict(source or {"commit": None, "dirty": None}),
        "funnel": {r["stage"]: r["n"] for r in _rows(funnel)},
        "stages": {name: dict(report) for name, report in stages.items()},
        "skips": _rows(stats.shares(skips).orderBy(F.desc("n"), "reason")),
        "composition": composition,
        **more,
    }


def _table(columns: list[str], rows: Iterable[Iterable], right: int) -> str:
    """Markdown; the last `right` columns are numbers."""
    rule = ["---"] * (len(columns) - right) + ["---:"] * right
    return "".join("| " + " | ".join(map(str, r)) + " |\n" for r in [columns, rule, *rows])


def tier_table(rows: Iterable[Mapping]) -> str:
    """Tier by split at one horizon."""
    own = [[r["tier"], r["split"], r["samples"], r["pedestrians"], r["crossers"], f"{r['crossing_ratio']:.3f}"] for r in rows if r["level"] == 0]
    return _table(["tier", "split", "samples", "pedestrians", "crossers", "crossing ratio"], own, 4)


def stage_table(stages: Mapping[str, Mapping], shapes: Iterable[Stage]) -> str:
    """One row for each stage that has a report, in the order of `shapes`."""
    fill = _Known().vformat
    own = [[s.name, *[fill(text, (), stages[s.name]) for text in (s.took, s.gave, s.known)]] for s in shapes if s.name in stages]
    return _table(["stage", "in", "out", "known error"], own, 0)


def skip_table(rows: list[Mapping]) -> str:
    """Windows that were dropped, by reason, most first, with their share of all dropped ones."""
    if not rows:
        return "Nothing was skipped.\n"
    own = [[f"`{r['reason']}`", r["n"], f"{r['share']:.0%}"] for r in rows]
    return _table(["gate", "dropped", "share"], [*own, ["**total**", sum(r["n"] for r in rows), ""]], 2)


def summary(made: Mapping, shapes: Iterable[Stage], horizon: str) -> str:
    """The summary of a manifest. It holds no number that the manifest does not."""
    rows = made["composition"].get(horizon, [])
    whole = next((r for r in rows if r["level"] == 3), None)
    source = made["source"]
    changed = ", with uncommitted changes" if source.get("dirty") else ""
    counted = f"{whole['samples']} samples of {whole['pedestrians']} pedestrians in {whole['sequences']} sequences." if whole else "No samples."
    by_tier = "".join(f"- {r['tier']}: {r['samples']} samples, crossing ratio {r['crossing_ratio']:.3f}\n" for r in rows if r["level"] == 1)
    flow = " → ".join(f"{n} {name}" for name, n in made["funnel"].items())
    return f"""# Snapshot {made["version"]}

Made {made["created"]} from commit `{(source.get("commit") or "unknown")[:12]}`{changed}. {counted}

## Stages

{stage_table(made["stages"], shapes)}
## Composition at {horizon} s

{tier_table(rows)}
The tiers are reported apart; a ratio over both describes neither.

{by_tier}
## Funnel and skips

{flow}

{skip_table(made["skips"])}
## Files

Tables are Parquet folders. `{MANIFEST}` holds all counts at every horizon, `{CHECKSUMS}` the SHA-256 of every other file.
"""


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file through Spark's file systems."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(own, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def build(spark: SparkSession, folder: str, tables: Mapping[str, DataFrame], made: dict, shapes: Iterable[Stage], horizon: str, needed: Iterable[str] = (), force: bool = False) -> int:
    """Writes the bundle and returns how many files its checksums list.

    Missing inputs and, unless `force`d, an existing folder are refused before anything is written. The bundle is built beside its place
    and takes its name at the end, so a failed build leaves an older one whole, and two builds are never mixed.
    """
    require(spark, needed)
    with replaced(spark, folder, force) as fresh:
        for name, rows in tables.items():
            rows.write.parquet(f"{fresh}/{name}")
        put_text(spark, f"{fresh}/{MANIFEST}", json.dumps(made, indent=1, sort_keys=True, default=str) + "\n")
        put_text(spark, f"{fresh}/{SUMMARY}", summary(made, shapes, horizon))
        listed = integrity.file_checksums(spark, fresh, relative=True).orderBy("path").collect()  # a line a file
        put_text(spark, f"{fresh}/{CHECKSUMS}", "".join(f"{r['sha256']}  {r['path']}\n" for r in listed))
    return len(listed)


def verify(spark: SparkSession, folder: str) -> DataFrame:
    """path, problem of every file of a bundle that is not as its checksums say; a bundle without them is an error."""
    require(spark, [f"{folder}/{CHECKSUMS}"])
    line = spark.read.text(f"{folder}/{CHECKSUMS}").where("value <> ''")
    listed = line.select(F.substring("value", 67, 1 << 20).alias("path"), F.substring("value", 1, 64).alias("sha256"))
    return integrity.verify(listed, integrity.file_checksums(spark, folder, relative=True).where(F.col("path") != CHECKSUMS))
