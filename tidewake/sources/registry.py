"""Vessel registry as a table: search, best match for each vessel, and enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Columns of a registry table; every position in ``pos`` is the provider's order.
COLUMNS = "reg_mmsi long, registry_name string, reported_name string, flag string, imo string, callsign string, pos int"

# Ship-type codes of position messages.
SHIP_TYPES = {30: "fishing", 31: "tug", 32: "tug", 52: "tug", 36: "sailing", 37: "pleasure", 60: "passenger", 70: "cargo", 80: "tanker", 90: "other"}


def ship_type_label(code):
    """Label of a numeric type column: decades of passenger, cargo and tanker ships, single codes, else other."""
    single = F.create_map(*[F.lit(x) for pair in SHIP_TYPES.items() for x in pair])
    return (
        F.when(code.isNull() | (code == 0), F.lit(None).cast("string"))
        .when(code.between(61, 69), "passenger").when(code.between(71, 79), "cargo").when(code.between(81, 89), "tanker")
        .otherwise(F.coalesce(F.try_element_at(single, code.cast("int")), F.lit("other")))
    )


def search(registry: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """Vessels whose number, IMO or name matches, in the provider's order."""
    text = query.strip().lower()
    hit = (F.col("reg_mmsi").cast("string") == text) | (F.col("imo") == text) | F.lower(F.coalesce("registry_name", "reported_name")).contains(text)
    return registry.where(hit).orderBy("pos", "reg_mmsi").limit(limit).withColumn("name", F.coalesce("registry_name", "reported_name"))


def enrich(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """Candidates with flag, IMO and call sign; a missing name is filled, scores stay.

    Of several entries for a vessel the one with its very number and the first
    position is taken.
    """
    first = Window.partitionBy("reg_mmsi").orderBy("pos")
    best = registry.withColumn("n", F.row_number().over(first)).where("n = 1")
    best = best.select("reg_mmsi", F.coalesce("registry_name", "reported_name").alias("reg_name"), "flag", "imo", "callsign")
    joined = candidates.join(best, candidates["mmsi"] == best["reg_mmsi"], "left")
    return joined.withColumn("vessel_name", F.coalesce("vessel_name", "reg_name")).drop("reg_mmsi", "reg_name")
