"""Provider payloads: hourly JSON, national grid text, record inventories and expected-object plans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.functions.exprs import ColumnLike, col, sum_when
from windrow.functions.timekeys import hours

# fixed values
GRID_COLUMNS, GRID_ROWS = 149, 253
GRID_RANGE = (0.0, 75.0)
GRID_SENTINEL = -99.0
INDEX_PATTERN = r"^(\d+):(\d+):d=(\d{10}):(.*)$"
ENSEMBLE_INIT_LAG_DAYS = 2
RUN_CYCLES = (0, 6, 12, 18)


def hourly_payload(df: DataFrame, payload: str, variable: str, keys: Sequence[str]) -> DataFrame:
    """(keys, time, value) rows of JSON documents {hourly: {time: [...], <variable>: [...]}}; lists of different length
    fail the job."""
    schema = f"hourly struct<time: array<string>, `{variable}`: array<double>>, error boolean"
    doc = F.from_json(col(payload), schema)
    rows = df.select(*keys, doc["hourly"]["time"].alias("_t"), doc["hourly"][variable].alias("_v"), F.coalesce(doc["error"], F.lit(False)).alias("_e"))
    ok = ~F.col("_e") & F.col("_t").isNotNull() & (F.size("_t") == F.size("_v"))
    zipped = F.when(ok, F.arrays_zip("_t", "_v")).otherwise(F.raise_error(F.lit("payload error or time/value length mismatch")))
    return rows.select(*keys, F.explode(zipped).alias("r")).select(*keys, F.col("r._t").try_cast("timestamp_ntz").alias("time"), F.col("r._v").alias("value"))


def payload_census(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    have = F.col("value").isNotNull()
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), sum_when(have).alias("non_null_rows"), F.min("time").alias("first_timestamp"), F.max("time").alias("last_timestamp"),
        F.min(F.when(have, F.col("time"))).alias("first_non_null"), F.max(F.when(have, F.col("time"))).alias("last_non_null"))


def grid_cells(df: DataFrame, text: str, cells: Mapping[str, tuple[int, int]], keys: Sequence[str], columns: int = GRID_COLUMNS, rows: int = GRID_ROWS) -> DataFrame:
    """Selected one-based (x, y) cells of comma-separated grid texts with the token and sentinel counts.

    A single trailing comma is allowed.  A wrong number of tokens, an unreadable token or a selected value out of range
    fails the job.
    """
    trimmed = F.regexp_replace(col(text), r"^\s+|\s+$", "")
    tokens = F.split(F.regexp_replace("_x", ",$", ""), ",")
    parsed = df.withColumn("_x", trimmed).withColumn("_v", F.transform(tokens, lambda t: F.trim(t).try_cast("double"))).withColumn("_trail", F.col("_x").endswith(","))
    whole = (F.size("_v") == columns * rows) & ~F.exists("_v", lambda v: v.isNull())
    out = {"token_count": F.size("_v"), "trailing_comma": F.col("_trail"), "sentinels": F.size(F.filter("_v", lambda v: v <= GRID_SENTINEL))}
    for name, (x, y) in cells.items():
        v = F.try_element_at("_v", F.lit((y - 1) * columns + x))
        out[name] = F.when(whole & v.between(*GRID_RANGE), v).otherwise(F.raise_error(F.lit("grid text does not match its contract")))
    return parsed.select(*keys, *[c.alias(n) for n, c in out.items()])


def index_records(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """One row per line of an index text: record number, offset, initialisation, variable, level, descriptor.

    Lines unfold with their position, and the byte range ends before the next record's offset, taken from the next line of
    the same text; no window over objects is needed.  The last record ends with the object.
    """
    lines = F.filter(F.split(col(text), r"\r?\n"), lambda s: F.trim(s) != "")
    number = lambda s, g: F.regexp_extract(s, INDEX_PATTERN, g)
    parsed = F.transform(lines, lambda s: F.struct(
        number(F.trim(s), 1).try_cast("int").alias("record"), number(F.trim(s), 2).try_cast("bigint").alias("offset"), number(F.trim(s), 3).alias("initialization"),
        F.split(number(F.trim(s), 4), ":").alias("tail")))
    rows = df.select("*", parsed.alias("_p")).withColumn("_n", F.transform("_p", lambda r, i: F.try_element_at("_p", i + 2)["offset"]))
    flat = rows.select(*keys, F.posexplode(F.arrays_zip("_p", "_n")).alias("_i", "_z")).select(*keys, "_i", "_z._p.*", F.col("_z._n").alias("next_offset"))
    tail = F.col("tail")
    good = F.col("offset").isNotNull() & (F.size(tail) >= 3) & (F.col("record") == F.col("_i") + 1) & (F.col("next_offset").isNull() | (F.col("next_offset") > F.col("offset")))
    return flat.select(
        *keys, F.when(good, F.col("record")).otherwise(F.raise_error(F.lit("malformed record index"))).alias("record"), "offset", "initialization",
        F.element_at(tail, 1).alias("variable"), F.element_at(tail, 2).alias("level"), F.rtrim(F.array_join(F.slice(tail, 3, 99), ":"), F.lit(":")).alias("descriptor"), "next_offset")


def byte_ranges(records: DataFrame, object_size: ColumnLike) -> DataFrame:
    end = F.coalesce(F.col("next_offset") - 1, col(object_size) - 1)
    valid = (F.col("offset") >= 0) & (end >= F.col("offset")) & (end < col(object_size))
    return records.withColumns({"byte_start": F.col("offset"), "byte_end": end, "byte_count": end - F.col("offset") + 1, "range_valid": valid})


def unique_record(records: DataFrame, keys: Sequence[str], variable: str, level: str) -> DataFrame:
    """The single record of a variable and level per object; none or several fail the job."""
    hit = (F.col("variable") == variable) & (F.col("level") == level)
    out = records.groupBy(*keys).agg(sum_when(hit).alias("_n"), F.max(F.when(hit, F.struct("byte_start", "byte_end", "byte_count", "range_valid", "record"))).alias("_r"))
    return out.select(*keys, F.when(F.col("_n") == 1, F.col("_r")).otherwise(F.raise_error(F.lit("record is not unique"))).alias("_r")).select(*keys, "_r.*")


def expected_objects(days: DataFrame, leads: Sequence[int], products: Sequence[str], day: str = "day") -> DataFrame:
    """Plan of every day x lead x product with its object key; leads and products are short registered lists."""
    init = F.col(day) - F.expr(f"INTERVAL {24 * ENSEMBLE_INIT_LAG_DAYS} HOUR")
    rows = days.select(day, F.explode(F.array(*[F.lit(int(x)) for x in leads])).alias("lead")).withColumn("product", F.explode(F.array(*[F.lit(p) for p in products])))
    return rows.withColumn("object_key", F.concat(F.lit("run."), F.date_format(init, "yyyyMMdd"), F.lit("/00/"), F.col("product"), F.format_string(".f%03d", F.col("lead"))))


def census(expected: DataFrame, inventory: DataFrame, keys: Sequence[str], day: str = "day") -> DataFrame:
    """Per day: expected and present objects and whether the day is complete.  The inventory's keys are reduced first, so
    repeats in it do not matter."""
    have = inventory.select(*keys).distinct().withColumn("_have", F.lit(1))
    return expected.join(have, list(keys), "left").groupBy(day).agg(
        F.count(F.lit(1)).alias("expected"), F.count("_have").alias("present")).withColumn("complete", F.col("expected") == F.col("present"))


def missing_objects(expected: DataFrame, inventory: DataFrame, keys: Sequence[str]) -> DataFrame:
    return expected.join(inventory.select(*keys).distinct(), list(keys), "left_anti")


def run_schedule(days: DataFrame, day: str = "day", cycle: int = 12, zone_offset: int = 9) -> DataFrame:
    """Per operating day and valid hour: cutoff and initialisation in UTC, forecast hour and object key.

    The operating day is local; its 24 valid hours are 01:00 ... 00:00 local time.  The run used is the one of two days
    before at the given cycle, which is out before the cutoff.
    """
    if cycle not in RUN_CYCLES:
        raise ValueError("unknown run cycle")
    rows = days.select(day, F.explode(F.sequence(F.lit(1), F.lit(24))).alias("_h"))
    valid = F.timestamp_add("HOUR", F.col("_h") - zone_offset, F.col(day))
    init = F.col(day) - hours(48) + hours(cycle)
    rows = rows.select(day, valid.alias("valid_utc"), (F.col(day) - hours(10 + zone_offset)).alias("cutoff_utc"), init.alias("init_utc"))
    lead = F.timestamp_diff("HOUR", F.col("init_utc"), F.col("valid_utc"))
    rows = rows.withColumn("forecast_hour", lead)
    key = F.concat(F.lit("gfs."), F.date_format("init_utc", "yyyyMMdd"), F.lit("/"), F.date_format("init_utc", "HH"), F.lit("/atmos/gfs.t"), F.date_format("init_utc", "HH"),
                   F.lit("z.pgrb2.0p25.f"), F.lpad(F.col("forecast_hour").cast("string"), 3, "0"))
    return rows.withColumn("object_key", key)

