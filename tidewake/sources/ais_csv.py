"""Vessel positions from CSV: header aliases, validation with quarantine, and the writer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake.config import DEFAULTS
from tidewake.functions.text import epoch, iso

# Accepted header names, in order of preference.
ALIASES: dict[str, tuple[str, ...]] = {
    "mmsi": ("mmsi", "MMSI", "userid", "UserID"),
    "timestamp_utc": ("timestamp_utc", "timestamp", "BaseDateTime", "basedatetime", "time", "datetime", "time_utc", "TIMESTAMP UTC", "# Timestamp", "ts"),
    "longitude": ("longitude", "lon", "LON", "Longitude", "long", "x"),
    "latitude": ("latitude", "lat", "LAT", "Latitude", "y"),
    "sog_knots": ("sog_knots", "sog", "SOG", "speed", "speed_knots", "Speed"),
    "cog_deg": ("cog_deg", "cog", "COG", "course", "Course"),
    "heading_deg": ("heading_deg", "heading", "Heading", "true_heading", "TrueHeading"),
    "vessel_name": ("vessel_name", "name", "VesselName", "shipname", "ship_name", "Name"),
    "vessel_type": ("vessel_type", "type", "VesselType", "shiptype", "ship_type", "Ship type"),
    "length_m": ("length_m", "length", "Length", "loa"),
    "source": ("source", "Source", "provider"),
}
REQUIRED = ("mmsi", "timestamp_utc", "longitude", "latitude")
ISO_FORMATS = ("yyyyMMdd'T'HHmmss", "yyyyMMdd'T'HHmmssX", "yyyyMMddHHmmss")
MONTH_FIRST = ("M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy", "M-d-yyyy H:mm", "MMM d, yyyy H:mm", "d MMM yyyy H:mm:ss")
COLUMNS = tuple(ALIASES)


def resolve_header(columns: list[str]) -> dict[str, str]:
    """Canonical name to column; the first alias that is there wins."""
    present = {c.lower().strip(): c for c in columns}
    found = {name: next((present[a.lower()] for a in names if a.lower() in present), None) for name, names in ALIASES.items()}
    if missing := [c for c in REQUIRED if not found[c]]:
        raise ValueError(f"missing columns {missing}; found {columns[:20]}")
    return {k: v for k, v in found.items() if v}


def sniff_separator(first_line: str) -> str:
    return max(",;\t|", key=first_line.count)


def read_csv(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """Canonical string columns and ``row``, the line in the file counted from 2 for the first record.

    More than ``max_rows`` rows are an error.  Uploads have that limit (``load``); tables that Spark wrote have none.

    Rows get their number from their place in the file, which holds for one
    file; a folder of files numbers each by itself in ``_metadata`` order.
    """
    first = spark.read.text(path).limit(1).collect()
    sep = sniff_separator(first[0][0]) if first else ","
    raw = spark.read.option("header", True).option("inferSchema", False).option("sep", sep).option("quote", '"').option("escape", '"').csv(path)
    if max_rows is not None and raw.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} rows")
    header = resolve_header(raw.columns)
    quoted = {k: F.col("`" + v.replace("`", "``") + "`") for k, v in header.items()}
    picked = raw.select(*[F.coalesce(F.trim(quoted[c]), F.lit("")).alias(c) if c in quoted else F.lit("").alias(c) for c in COLUMNS])
    return numbered(picked, 2)


def numbered(rows: DataFrame, first: int = 0) -> DataFrame:
    """``rows`` with ``row``, their place in the order in which they are read.

    A row's number in its partition comes from its id; the rows before the
    partition from one count a partition, a small table.
    """
    known = rows.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33))
    counts = rows.select(F.spark_partition_id().cast("long").alias("__part")).groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.col("__start") + F.col("__id") - F.shiftleft(F.col("__part"), 33) + first
    return known.join(starts, "__part").withColumn("row", place).drop("__id", "__part", "__start")


def number(text: Column) -> Column:
    return F.nullif(F.trim(text).try_cast("double"), F.lit(float("nan")))


def timestamp_column(rows: DataFrame, column: str = "timestamp_utc") -> Column:
    """How to read the column, decided by all of it.

    Mostly numbers are epochs, in milliseconds if their median is over 1e11;
    else ISO 8601, and if that fails for most, month-first dates.
    """
    text, n = F.trim(F.col(column)), number(F.col(column))
    as_iso = F.coalesce(F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(f)) for f in ISO_FORMATS])
    seen = rows.agg(F.avg(n.isNotNull().cast("int")).alias("numeric"), F.percentile_approx(n, 0.5, 10000).alias("middle"), F.avg(as_iso.isNull().cast("int")).alias("bad")).first()
    if (seen["numeric"] or 0) > 0.9:
        scale = 1000 if seen["middle"] > 1e11 else 1_000_000
        return F.timestamp_micros(F.round(n * scale).cast("long"))
    if (seen["bad"] or 0) > 0.5:
        return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in MONTH_FIRST], as_iso)
    return as_iso


def reason(mmsi: Column, ts: Column, lon: Column, lat: Column) -> Column:
    """Why a row is bad: the first that holds of identity, time and position; null for a good row."""
    return F.coalesce(
        F.when(mmsi.isNull() | ~mmsi.between(1_000_000, 999_999_999), "invalid_mmsi"),
        F.when(ts.isNull(), "unparseable_timestamp"),
        F.when(lon.isNull() | lat.isNull() | ~lon.between(-180, 180) | ~lat.between(-90, 90) | ((lon == 0) & (lat == 0)), "invalid_position"),
    )


def normalised(rows: DataFrame, source_label: str, ts: Column | None = None) -> DataFrame:
    """Typed positions with ``reason``, null for valid rows; out-of-range readings become null."""
    ts = timestamp_column(rows) if ts is None else ts

    def within(c: str, low: float, high: float, closed: bool) -> Column:
        x = number(F.col(c))
        return F.when((x >= low) & ((x <= high) if closed else (x < high)), x)

    lon, lat = number(F.col("longitude")), number(F.col("latitude"))
    mmsi = number(F.col("mmsi"))

    def text(c: Column) -> Column:
        return F.nullif(F.trim(c), F.lit(""))

    return rows.select(
        "row", F.when(mmsi.between(-9e18, 9e18), mmsi).cast("long").alias("mmsi"), ts.alias("ts"), epoch(ts).alias("ts_epoch"), lon.alias("lon"), lat.alias("lat"),
        within("sog_knots", 0, 102.2, True).alias("sog"), within("cog_deg", 0, 360, False).alias("cog"), within("heading_deg", 0, 360, False).alias("heading"),
        text(F.col("vessel_name")).alias("vessel_name"), text(F.lower("vessel_type")).alias("vessel_type"), number(F.col("length_m")).alias("length_m"),
        F.coalesce(text(F.col("source")), F.lit(source_label)).alias("source"), reason(mmsi, ts, lon, lat).alias("reason"),
    )


@dataclass
class Import:
    """Valid positions, the quarantined rows, and the summary of both."""

    positions: DataFrame
    quarantined: DataFrame
    summary: dict


def load(spark: SparkSession, path: str, case_id: str, import_id: str, source_label: str, data_mode: str, case_mode: str | None = None, max_rows: int = DEFAULTS["ais"]["csv"]["max_rows"]) -> Import:
    """Reads, validates and summarises one file.

    A source that says "synth", or a synthetic case, makes the import synthetic
    whatever mode was asked for.
    """
    tagged = normalised(read_csv(spark, path, max_rows), source_label).cache()
    valid, bad = tagged.where("reason is null"), tagged.where("reason is not null")
    total = tagged.agg(
        F.count("*").alias("rows_total"), F.count_if(F.col("reason").isNull()).alias("rows_valid"), F.count_if(F.col("reason").isNotNull()).alias("rows_quarantined"),
    ).first()
    if not total["rows_valid"]:
        raise ValueError(f"none of {total['rows_total']} rows is a valid position")
    seen = summary(valid).first()
    synthetic = bool(seen["synthetic"]) or case_mode == "synthetic"
    why = "source column" if seen["synthetic"] else "case" if synthetic else None
    out = total.asDict() | {k: seen[k] for k in ("vessels", "time_start", "time_end", "west", "south", "east", "north")}
    out |= {"reasons": {r["reason"]: r["n"] for r in bad.groupBy("reason").agg(F.count("*").alias("n")).collect()}}
    out |= {"quarantine_sample": [r.asDict() for r in bad.orderBy("row").limit(25).select("row", "mmsi", F.col("ts").cast("string").alias("timestamp"), "reason").collect()], "data_mode": "synthetic" if synthetic else data_mode, "data_mode_forced_by": why}
    positions = valid.select(F.lit(case_id).alias("case_id"), F.lit(import_id).alias("import_id"), *[c for c in valid.columns if c not in ("row", "reason")])
    return Import(positions, bad, out)


def summary(valid: DataFrame) -> DataFrame:
    return valid.agg(
        F.count("*").alias("positions"), F.countDistinct("mmsi").alias("vessels"), F.min("ts").alias("time_start"), F.max("ts").alias("time_end"),
        F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"),
        F.coalesce(F.bool_or(F.lower("source").contains("synth")), F.lit(False)).alias("synthetic"),
    )


def write_csv(positions: DataFrame, path: str) -> None:
    """Positions under the canonical header."""
    out = positions.select(
        "mmsi", iso(F.col("ts")).alias("timestamp_utc"), F.col("lon").alias("longitude"), F.col("lat").alias("latitude"), F.col("sog").alias("sog_knots"),
        F.col("cog").alias("cog_deg"), F.col("heading").alias("heading_deg"), "vessel_name", "vessel_type", "length_m", "source",
    )
    out.write.mode("overwrite").option("header", True).csv(path)
