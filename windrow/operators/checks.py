"""Integrity checks, time guards, folds and evidence ladders.

A check returns a table (rule, count, examples) or flag columns; nothing row-sized is brought to the driver.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.functions.exprs import ColumnLike, col, finite, sum_when
from windrow.functions.timekeys import RUN_HOURS, decision_cutoff, hours_between

# fixed values: names that may not reach a feature table
FORBIDDEN_FEATURE_PATTERN = r"(^target_group_|scada|target|label|power_kw|actual)"
SHA256_PATTERN = "^[0-9a-f]{64}$"


def forbidden_columns(columns: Sequence[str], pattern: str = FORBIDDEN_FEATURE_PATTERN) -> list[str]:
    return [c for c in columns if re.search(pattern, c, re.IGNORECASE)]


def reject_forbidden(df: DataFrame, pattern: str = FORBIDDEN_FEATURE_PATTERN) -> DataFrame:
    """Refuse a frame by its schema, before any value is read."""
    bad = forbidden_columns(df.columns, pattern)
    if bad:
        raise ValueError(f"forbidden columns: {bad}")
    return df


def name_rules(names: DataFrame, name: str, *, prefixes: Sequence[str], tokens: Sequence[str], forbidden: Sequence[str], pattern: str = FORBIDDEN_FEATURE_PATTERN) -> DataFrame:
    """The rules of :func:`selected_columns` and :func:`forbidden_columns` over a table of names: columns selected and refused."""
    either = lambda parts: reduce(lambda a, b: a | b, parts, F.lit(False))
    n = F.col(name)
    named = either([n.startswith(p) for p in prefixes]) | either([n.contains(t) for t in tokens])
    return names.withColumns({"selected": named & ~either([F.lower(n).contains(t) for t in forbidden]), "refused": n.rlike(f"(?i){pattern}")})


def same_schema(first: DataFrame, second: DataFrame) -> None:
    if first.columns != second.columns:
        raise ValueError("column order or names differ")


def violations(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(rule, n) with one row per rule; every part is a frame of offending rows."""
    counted = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n") for rule, df in parts]
    return reduce(DataFrame.unionByName, counted)


def grid_integrity(df: DataFrame, catalogue: DataFrame, ts: str = "forecast_ts", issued: str = "issued_ts",
                   grid: str = "grid_id", coords: Sequence[str] = ("lat", "lon"), tolerance: float = 1e-5) -> DataFrame:
    """Seven rules over a gridded forecast: duplicate and null keys, several issuances for one hour, negative lead, a grid
    with several coordinates, a catalogue that changed, hours that do not hold every grid.

    Duplicates, issuances and completeness come out of two aggregates that share the hour; no self-join.
    """
    nulls = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in (ts, issued, grid, *coords)])
    per_cell = df.groupBy(ts, grid).agg(
        F.count(F.lit(1)).alias("rows"), F.min(issued).alias("first_issue"), F.max(issued).alias("last_issue")
    )
    size = catalogue.agg(F.countDistinct(grid)).scalar()
    per_hour = per_cell.groupBy(ts).agg(
        F.sum((F.col("rows") > 1).cast("int")).alias("duplicates"),
        F.count(F.lit(1)).alias("grids"),
        F.min("first_issue").alias("first_issue"), F.max("last_issue").alias("last_issue"),
    ).withColumn("expected", size)
    per_grid = df.groupBy(grid).agg(*[F.min(c).alias(f"{c}_lo") for c in coords], *[F.max(c).alias(f"{c}_hi") for c in coords])
    moved = per_grid.join(catalogue.select(grid, *coords), grid, "full")
    changed = reduce(lambda a, b: a | b, [
        F.coalesce(F.abs(F.col(f"{c}_lo") - F.col(c)) > tolerance, F.lit(True)) for c in coords
    ])
    several = reduce(lambda a, b: a | b, [F.col(f"{c}_lo") != F.col(f"{c}_hi") for c in coords])
    row_rules = df.agg(
        sum_when(nulls).alias("null_key"), sum_when(hours_between(ts, issued) < 0).alias("negative_lead")
    ).select(F.inline(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.col(r).alias("n")) for r in ("null_key", "negative_lead")
    ])))
    hour_rules = per_hour.agg(
        F.coalesce(F.sum("duplicates"), F.lit(0)).cast("bigint").alias("duplicate_key"),
        sum_when(F.col("first_issue") != F.col("last_issue")).alias("several_issuances"),
        sum_when(F.col("grids") != F.col("expected")).alias("incomplete_grid"),
    ).select(F.inline(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.col(r).alias("n")) for r in ("duplicate_key", "several_issuances", "incomplete_grid")
    ])))
    grid_rules = violations([("several_coordinates", per_grid.where(several)), ("changed_catalogue", moved.where(changed))])
    return row_rules.unionByName(hour_rules).unionByName(grid_rules)


def complete_runs(df: DataFrame, keys: Sequence[str], ts: str = "forecast_ts", hours: int = RUN_HOURS) -> DataFrame:
    """Per run: row count, first and last hour, and whether it covers 01:00 ... 00:00 without a gap or repeat."""
    runs = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_hours"), F.countDistinct(ts).alias("n_distinct"),
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
    )
    ok = (
        (F.col("n_hours") == hours) & (F.col("n_distinct") == hours)
        & (hours_between("last_ts", "first_ts") == hours - 1) & (F.hour("first_ts") == 1) & (F.hour("last_ts") == 0)
    )
    return runs.withColumn("complete", ok)


def key_report(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Are the key sets of two frames identical and unique?  One shuffle of tagged keys instead of a join each way."""
    keys = list(keys)
    tagged = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    counts = tagged.groupBy(*keys).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return counts.agg(
        sum_when((F.col("l") > 0) & (F.col("r") > 0)).alias("matched"),
        sum_when(F.col("r") == 0).alias("left_only"), sum_when(F.col("l") == 0).alias("right_only"),
        sum_when(F.col("l") > 1).alias("left_duplicates"), sum_when(F.col("r") > 1).alias("right_duplicates"),
    ).withColumn("one_to_one", (F.col("left_only") + F.col("right_only") + F.col("left_duplicates") + F.col("right_duplicates")) == 0)


def exact_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], expected_rows: int | None = None) -> DataFrame:
    """Inner join of two frames whose key sets must be identical and unique."""
    found = key_report(left, right, keys).first()
    if not found["one_to_one"]:
        raise ValueError(f"keys are not one to one: {found.asDict()}")
    if expected_rows is not None and found["matched"] != expected_rows:
        raise ValueError(f"expected {expected_rows} rows, found {found['matched']}")
    return left.join(right, list(keys))


def many_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join that keeps every left row once; a key that ``right`` holds twice fails the job when it is read."""
    values = [c for c in right.columns if c not in keys]
    once = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in values])
    checked = [F.when(F.col("_n") == 1, F.col(c)).otherwise(F.raise_error(F.lit("a key of the right side is not unique"))).alias(c) for c in values]
    return left.join(once.select(*keys, *checked), list(keys), "left")


def differing_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows (with multiplicity) that only one side has; empty when two frames hold the same rows."""
    cols = left.columns
    return left.exceptAll(right.select(*cols)).withColumn("side", F.lit("left")).unionByName(
        right.select(*cols).exceptAll(left).withColumn("side", F.lit("right"))
    )


def strict_forward(fit: DataFrame, apply: DataFrame, ts: str) -> DataFrame:
    """Fit rows must end before application rows begin; two one-row aggregates decide it."""
    a = fit.agg(F.max(ts).alias("fit_end"), F.count(F.lit(1)).alias("fit_rows"))
    b = apply.agg(F.min(ts).alias("apply_start"), F.count(F.lit(1)).alias("apply_rows"))
    return a.join(F.broadcast(b)).withColumn("forward", F.coalesce(F.col("fit_end") < F.col("apply_start"), F.lit(False)))


def overlapping_rows(fit: DataFrame, apply: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Application keys that were also used for fitting."""
    return apply.select(*keys).join(fit.select(*keys).distinct(), list(keys), "left_semi")


def fold_roles(df: DataFrame, folds: Sequence[Mapping[str, str]], ts: str) -> DataFrame:
    """Half-open expanding folds: a row appears once per fold it belongs to with its role.  The fold list is short and
    literal, so membership is an array expression and needs no join."""
    options = []
    for f in folds:
        for role in ("train", "valid"):
            inside = (F.col(ts) >= F.lit(f[f"{role}_start"]).cast("timestamp_ntz")) & (
                F.col(ts) < F.lit(f[f"{role}_end"]).cast("timestamp_ntz"))
            options.append(F.when(inside, F.struct(F.lit(f["name"]).alias("fold"), F.lit(role).alias("role"))))
    return df.withColumn("_f", F.explode(F.array_compact(F.array(*options)))).select(*df.columns, "_f.fold", "_f.role")


def fold_report(roles: DataFrame, ts: str) -> DataFrame:
    """Rows per role and the leak check of every fold."""
    train, valid = F.col("role") == "train", F.col("role") == "valid"
    out = roles.groupBy("fold").agg(
        sum_when(train).alias("train_rows"), sum_when(valid).alias("valid_rows"),
        F.max(F.when(train, F.col(ts))).alias("train_end"), F.min(F.when(valid, F.col(ts))).alias("valid_start"),
    )
    ok = (F.col("train_rows") > 0) & (F.col("valid_rows") > 0) & (F.col("train_end") < F.col("valid_start"))
    return out.withColumn("leak_free", ok)


def partition_label(value: ColumnLike, bins: Sequence[tuple[str, float, float]]) -> Column:
    """Name of the half-open bin a value falls into; null outside, an error where two bins claim it."""
    c = col(value)
    hits = F.array_compact(F.array(*[F.when((c >= lo) & (c < hi), F.lit(name)) for name, lo, hi in bins]))
    return F.when(F.size(hits) > 1, F.raise_error(F.lit("overlapping bins"))).otherwise(F.try_element_at(hits, F.lit(1)))


def partition_report(df: DataFrame, keys: Sequence[str], lead: str, bins: Sequence[tuple[str, float, float]],
                     rows_per_bin: int) -> DataFrame:
    """Per bin: rows, runs, the fewest and most rows of one run, and whether every run holds the registered number."""
    per_run = df.withColumn("bin", partition_label(lead, bins)).groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.min(lead).alias("lo"), F.max(lead).alias("hi")
    )
    return per_run.groupBy("bin").agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("runs"), F.min("n").alias("rows_per_run_min"),
        F.max("n").alias("rows_per_run_max"), F.min("lo").alias("lead_min"), F.max("hi").alias("lead_max"),
    ).withColumn("valid", F.col("bin").isNotNull() & (F.col("rows_per_run_min") == rows_per_bin)
                 & (F.col("rows_per_run_max") == rows_per_bin))


def after_cutoff(ts: ColumnLike, available: ColumnLike) -> Column:
    """True where information became available after the decision cutoff of its valid hour."""
    return col(available) > decision_cutoff(ts)


def cutoff_examples(df: DataFrame, ts: str, available: str, limit: int = 5) -> DataFrame:
    return df.where(after_cutoff(ts, available)).select(ts, available).orderBy(ts, available).limit(limit)


def cutoff_evidence(valid: ColumnLike, day_offset: ColumnLike, run_id: ColumnLike, issued: ColumnLike, published: ColumnLike,
                    raw_verified: ColumnLike) -> dict[str, Column]:
    """Proof that a previous-run value respected the cutoff of the day before its calendar day; what is missing or failed
    is listed in a fixed order."""
    day = F.date_trunc("day", col(valid)).cast("timestamp_ntz")
    cutoff = day - F.expr("INTERVAL 10 HOUR")
    nominal = F.timestamp_add("DAY", -col(day_offset), col(valid))
    has_run = col(run_id).isNotNull() & (col(run_id) != "")
    raw = F.coalesce(col(raw_verified), F.lit(False))
    issue_ok, publish_ok = col(issued) <= cutoff, col(published) <= cutoff
    passed = has_run & col(issued).isNotNull() & col(published).isNotNull() & raw & issue_ok & publish_ok
    problems = F.array_compact(F.array(
        F.when(~has_run, "exact_run_identifier"), F.when(col(issued).isNull(), "issue_time"),
        F.when(col(published).isNull(), "publication_time"), F.when(~raw, "immutable_raw_sha"),
        F.when(~issue_ok, "issue_after_cutoff"), F.when(~publish_ok, "publication_after_cutoff"),
    ))
    passed = F.coalesce(passed, F.lit(False))
    return {
        "cutoff": cutoff, "nominal_reference": nominal, "nominal_before_cutoff": nominal <= cutoff,
        "issue_before_cutoff": issue_ok, "publication_before_cutoff": publish_ok, "proven": passed,
        "reason": F.when(passed, F.lit("complete")).otherwise(
            F.concat(F.lit("missing_or_failed:"), F.concat_ws(",", problems))),
    }


def publication_status(key_observed: ColumnLike, modified: ColumnLike, cutoff: ColumnLike, sha: ColumnLike, size: ColumnLike,
                       range_matches: ColumnLike) -> Column:
    """First failing rung of the ladder, or VERIFIED."""
    return (
        F.when(~F.coalesce(col(key_observed), F.lit(False)), "MISSING_RUN_ID")
        .when(col(modified).isNull(), "MISSING_PUBLICATION_EVIDENCE")
        .when(col(modified) > col(cutoff), "AFTER_CUTOFF")
        .when(~F.coalesce(col(sha).rlike(SHA256_PATTERN), F.lit(False)), "MISSING_RAW")
        .when(~F.coalesce((col(size) > 0) & col(range_matches), F.lit(False)), "FAIL")
        .otherwise("VERIFIED")
    )


def prediction_contract(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Counts a prediction table must hold to zero: duplicate keys, null keys, non-finite and negative values."""
    nulls = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    bad = reduce(lambda a, b: a | b, [~finite(v) for v in values])
    below = reduce(lambda a, b: a | b, [F.coalesce(F.col(v) < 0, F.lit(False)) for v in values])
    per_key = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), sum_when(nulls).alias("nulls"), sum_when(bad).alias("bad"), sum_when(below).alias("below")
    )
    return per_key.agg(
        F.sum("rows").alias("rows"), sum_when(F.col("rows") > 1).alias("duplicate_keys"), F.sum("nulls").alias("null_keys"),
        F.sum("bad").alias("non_finite"), F.sum("below").alias("negative"),
    )


def selected_columns(columns: Sequence[str], *, prefixes: Sequence[str] = (), tokens: Sequence[str] = (),
                     forbidden: Sequence[str] = ()) -> list[str]:
    """Columns that start with one of the prefixes or contain one of the tokens, without the forbidden tokens, in order."""
    keep = [c for c in columns if c.startswith(tuple(prefixes)) or any(t in c for t in tokens)]
    return [c for c in keep if not any(t in c.lower() for t in forbidden)]
