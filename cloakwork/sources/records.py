"""Files that a run reads and leaves: map and candidates (YAML), decisions (JSONL), reports.

Maps, candidates and reports are for people and have a bounded size, so they
pass the driver; events and decisions are written by tasks.
"""

from __future__ import annotations

import json
import os
import posixpath
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..rules import CASE_INSENSITIVE, CATEGORIES

SMAP = "category string, entry_ord int, from string, to string, id string"
#: Rows that a file for people holds at most.
MOST_ROWS = 500_000

_STEPS: dict[tuple[str, int], Callable[[dict], dict]] = {}
VERSIONS = {"substitution_map": 1, "leak_patterns": 1, "decisions": 1}


def migration(kind: str, version: int) -> Callable[[Callable[[dict], dict]], Callable[[dict], dict]]:
    """Register a step from ``version`` to the next one."""

    def register(step: Callable[[dict], dict]) -> Callable[[dict], dict]:
        _STEPS[kind, version] = step
        return step

    return register


def migrate(kind: str, data: dict, target: int | None = None) -> tuple[dict, bool]:
    """Data at the target version, and whether its version was another one."""
    target = VERSIONS.get(kind, 1) if target is None else target
    version = before = int(data.get("version") or 1)
    while version < target:
        data = _STEPS.get((kind, version), lambda d: d)(data)
        version += 1
        data = {**data, "version": version}
    return data, before != target


def _gather(df: DataFrame) -> list:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows; write Parquet instead")
    return rows


def _replace(path: str, text: str) -> None:
    """Write beside the target, then rename: a crash leaves the old file whole."""
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(path + ".tmp", path)


def read_map(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The map of a YAML file and its options; unknown categories are left out, a missing file is an empty map."""
    import yaml

    data: dict = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            data, _ = migrate("substitution_map", yaml.safe_load(f) or {})
    rows = [(c, k, str(e.get("from") or ""), str(e.get("to") or ""), str(e.get("id") or "")) for c in CATEGORIES for k, e in enumerate(data.get(c) or [])]
    return spark.createDataFrame(rows, SMAP), data.get("options") or {"longest_first": True, "case_insensitive_categories": list(CASE_INSENSITIVE)}


def write_map(smap: DataFrame, path: str, options: dict | None = None) -> None:
    import yaml

    out: dict = {"version": VERSIONS["substitution_map"], "options": options or {"longest_first": True, "case_insensitive_categories": list(CASE_INSENSITIVE)}}
    by: dict[str, list] = {}
    for r in sorted(_gather(smap), key=lambda r: r["entry_ord"]):
        by.setdefault(r["category"], []).append({"from": r["from"], "to": r["to"], "id": r["id"]})
    _replace(path, yaml.safe_dump(out | {c: by[c] for c in CATEGORIES if c in by}, sort_keys=False, allow_unicode=True))


def write_candidates(cands: DataFrame, path: str) -> None:
    """Candidates by category, confidences with three places."""
    import yaml

    by: dict[str, list] = {}
    for r in _gather(cands):
        row = {k: round(v, 3) if isinstance(v, float) else v for k, v in r.asDict().items()}
        by.setdefault(row.get("category") or "other", []).append(row)
    _replace(path, yaml.safe_dump({"version": 1, "candidates_by_category": by}, sort_keys=False, allow_unicode=True))


def read_candidates(spark: SparkSession, path: str, schema: str) -> DataFrame:
    import yaml

    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f) or {}
    rows = [{**row, "category": row.get("category") or c} for c, rows in (data.get("candidates_by_category") or {}).items() for row in rows or [] if isinstance(row, dict)]
    names = [p.split()[0] for p in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def decisions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Indices (bucket, key, n) and decisions (seq, action, value, placeholder, category) of a JSONL log; broken lines are skipped."""
    raw = spark.read.schema("kind string, rule string, value string, placeholder string, action string, category string").json(path).withColumn("seq", F.monotonically_increasing_id())
    number = F.coalesce(F.col("placeholder").try_cast("long"), F.conv("placeholder", 16, 10).cast("long"))
    assigned = raw.where("kind = 't0_assign'").groupBy(F.col("rule").alias("bucket"), F.col("value").alias("key")).agg(F.min_by(number, "seq").alias("n")).where("n is not null")
    return assigned, raw.where("kind = 'decision'").select("seq", "action", "value", "placeholder", "category")


def append_decisions(made: DataFrame, path: str) -> None:
    """Add decisions (action, value, placeholder, category) to a log folder."""
    made.select(F.lit("decision").alias("kind"), "action", "value", "placeholder", "category").write.mode("append").json(path)


def apply_report(events: DataFrame) -> DataFrame:
    """One row per file: file, n_events, and its events as JSON in order of place."""
    row = F.struct("seg_id", "orig_off", "orig_len", "anon_off", "anon_len", "from", "to", "category", "mapping_id", "tier")
    return events.groupBy(F.col("file_rel").alias("file")).agg(F.count("*").alias("n_events"), F.to_json(F.sort_array(F.collect_list(row))).alias("events"))


def leak_report(hits: DataFrame, n_files: int, uninspected: list[str] | None = None) -> str:
    """Markdown with the status, the counts, each hit, and archives that nobody looked into."""
    rows = _gather(hits.orderBy("file_rel", "off", "pattern"))
    out = [f"# Verifier report - {f'{len(rows)} LEAKS' if rows else 'CLEAN'}", "", f"- files scanned: **{n_files}**", f"- residual hits: **{len(rows)}**", ""]
    if rows:
        out += ["| File | Pattern | Match | Snippet |", "|---|---|---|---|", *(f"| `{r['file_rel']}` | `{r['pattern']}` | `{r['match']}` | {r['snippet'][:120]} |" for r in rows), ""]
    if uninspected:
        out += ["## Archives (uninspected)", *(f"- `{a}`" for a in uninspected), ""]
    return "\n".join(out)


@dataclass(frozen=True)
class RunConfig:
    """What a run reads and where it writes."""

    inputs: tuple[str, ...]
    output: str
    mode: str = "folder"
    low: float = 0.75
    high: float = 0.92
    reject: float = 0.85
    keep_indices: bool = True
    chunking: str = "structured"

    def target(self, rel: str) -> str:
        """Where a file's result goes: by its name, or by its path below a folder input."""
        if self.mode == "single":
            stem, ext = posixpath.splitext(posixpath.basename(rel))
            return self.output if posixpath.splitext(self.output)[1] else posixpath.join(self.output, f"{stem}.anonymized{ext}")
        return posixpath.join(self.output, posixpath.basename(rel) if self.mode == "multi" else rel)

    def manifest(self, **stages: object) -> str:
        return json.dumps({"inputs": list(self.inputs), "output": self.output, "mode": self.mode, "stages": stages}, indent=2, default=str)
