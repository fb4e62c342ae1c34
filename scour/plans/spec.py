"""Declarative cleaning specs.

A spec is the reference's job config::

    {"job_name": "...",
     "source":    {"type": "parquet", "path": "..."},
     "operators": [{"type": "filter", "condition": "l_quantity > 10"},
                   {"type": "dedup"},
                   {"type": "outliers", "columns": ["l_extendedprice"]},
                   {"type": "standardize"}],
     "target":    {"type": "parquet", "path": "...", "mode": "overwrite"}}

``build`` folds the operators over the source into one lazy DataFrame.  The
spec is validated before anything is read; unknown operator types raise
instead of being skipped.  Operators that need statistics (outliers,
standardize, fill by mean/median/mode, explore) run their statistics jobs
while the plan is built.  When such an operator follows a shuffle (dedup), or
the source is text or a database (CSV, JSON, JDBC), the rows are first written
once as Parquet to the shared checkpoint folder and read back, so the several
statistics passes re-read a pruned columnar copy instead of re-running the
shuffle, re-parsing text or re-querying the database, and the lineage is cut
(executor loss recomputes from the written table, not from the start).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators import cleaning, stats
from ..session import delete_path, scratch_path
from ..sinks import write_target
from ..sources import read_source

# operator type -> (allowed argument names, required argument names)
OPERATORS: dict[str, tuple[set[str], set[str]]] = {
    "dedup": ({"columns", "order_by"}, set()),
    "filter": ({"condition"}, {"condition"}),
    "fill_na": ({"value", "method", "columns"}, set()),
    "drop_na": ({"columns", "how"}, set()),
    "explore": ({"error"}, set()),
    "outliers": ({"columns", "method", "factor", "sequential", "keep_nulls", "error"}, set()),
    "standardize": ({"columns"}, set()),
    "rename": ({"mapping"}, {"mapping"}),
}
SHUFFLING = {"dedup"}
# sources that are slow to read more than once: text to re-parse or a database to re-query
REREAD_COSTLY = {"csv", "json", "jdbc", "mysql", "clickhouse"}
STATISTICAL = {"outliers", "standardize", "explore"}


@dataclass
class SpecResult:
    df: DataFrame
    reports: list[dict] = field(default_factory=list)
    rows_written: int | None = None
    scratch: list[str] = field(default_factory=list)   # intermediate tables ``df`` reads


def validate(spec: dict, *, need_target: bool = False) -> None:
    if not isinstance(spec, dict):
        raise ValueError("spec must be a dict")
    src = spec.get("source")
    if not isinstance(src, dict) or not src.get("type"):
        raise ValueError("spec.source needs a 'type'")
    ops = spec.get("operators", [])
    if not isinstance(ops, list):
        raise ValueError("spec.operators must be a list")
    for i, op in enumerate(ops):
        if not isinstance(op, dict) or "type" not in op:
            raise ValueError(f"operator #{i} needs a 'type'")
        kind = op["type"]
        if kind not in OPERATORS:
            raise ValueError(f"operator #{i}: unknown type {kind!r}; known: {sorted(OPERATORS)}")
        allowed, required = OPERATORS[kind]
        args = set(op) - {"type"}
        extra, missing = args - allowed, required - args
        if extra:
            raise ValueError(f"operator #{i} ({kind}): unknown argument(s) {sorted(extra)}")
        if missing:
            raise ValueError(f"operator #{i} ({kind}): missing argument(s) {sorted(missing)}")
        if kind == "fill_na" and op.get("value") is None and op.get("method") in (None, "constant"):
            raise ValueError(f"operator #{i} (fill_na): needs 'value' or a 'method'")
    if need_target:
        tgt = spec.get("target")
        if not isinstance(tgt, dict) or not tgt.get("type"):
            raise ValueError("spec.target needs a 'type'")
        if "mode" not in tgt:
            raise ValueError("spec.target needs an explicit 'mode'")


def apply_operator(df: DataFrame, op: dict, reports: list[dict]) -> DataFrame:
    kind = op["type"]
    if kind == "dedup":
        return cleaning.dedup(df, op.get("columns"), op.get("order_by"))
    if kind == "filter":
        return cleaning.filter_rows(df, op["condition"])
    if kind == "fill_na":
        return cleaning.fill_na(df, op.get("value"), op.get("columns"), op.get("method"))
    if kind == "drop_na":
        return cleaning.drop_na(df, op.get("columns"), op.get("how", "any"))
    if kind == "explore":
        reports.append(stats.explore(df, error=op.get("error")))
        return df
    if kind == "outliers":
        return stats.handle_outliers(df, op.get("columns"), op.get("method", "iqr"),
                                     factor=op.get("factor", 1.5),
                                     sequential=op.get("sequential", True),
                                     keep_nulls=op.get("keep_nulls", True),
                                     error=op.get("error"))
    if kind == "standardize":
        return stats.standardize(df, op.get("columns"))
    if kind == "rename":
        return cleaning.rename_columns(df, op["mapping"])
    raise ValueError(f"unknown operator type {kind!r}")


def _needs_statistics(op: dict) -> bool:
    return op["type"] in STATISTICAL or (
        op["type"] == "fill_na" and op.get("method") in ("mean", "median", "mode"))


def materialize(df: DataFrame, name: str, scratch: list[str]) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    scratch.append(path)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def build(spark: SparkSession, spec: dict, df: DataFrame | None = None, *,
          connections: dict | None = None, materialize_after_shuffle: bool = True
          ) -> SpecResult:
    """Source + operators -> one lazy DataFrame (statistics already resolved)."""
    validate(spec)
    if df is None:
        df = read_source(spark, spec["source"], connections)
    reports: list[dict] = []
    scratch: list[str] = []
    # statistics operators read their input several times: make sure that input
    # is a columnar table, not a shuffle to redo or a text / database source
    costly = spec["source"]["type"] in REREAD_COSTLY
    for op in spec.get("operators", []):
        if costly and materialize_after_shuffle and _needs_statistics(op):
            df = materialize(df, spec.get("job_name", "spec"), scratch)
            costly = False
        df = apply_operator(df, op, reports)
        costly = costly or op["type"] in SHUFFLING
    return SpecResult(df, reports, scratch=scratch)


def run(spark: SparkSession, spec: dict, *, connections: dict | None = None,
        materialize_after_shuffle: bool = True) -> SpecResult:
    """Build the plan and write it to the spec's target, counting written rows.

    Intermediate tables are deleted once the target is written, so ``df`` of the
    result is then only good for its schema; read the target for the rows.
    """
    validate(spec, need_target=True)
    res = build(spark, spec, connections=connections,
                materialize_after_shuffle=materialize_after_shuffle)
    observed, obs = stats.observe_rows(res.df, "written")
    try:
        write_target(observed, spec["target"], connections)
        res.rows_written = obs.get.get("rows", 0)
    finally:
        for path in res.scratch:
            delete_path(spark, path)
    return res
