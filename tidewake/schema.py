"""Tables of a case store, as Spark schemas; JSON text stays a string column."""

from __future__ import annotations

from pyspark.sql.types import StructType

TABLES: dict[str, str] = {
    "cases": "id string, name string, status string, data_mode string, created_at timestamp, updated_at timestamp, config_snapshot string, notes string",
    "scenes": "id string, case_id string, acquisition_time timestamp, bounds array<double>, asset_uri string, preview_uri string, metadata string, created_at timestamp",
    "slicks": "id string, case_id string, scene_id string, geom string, class string, confidence double, properties string, review_status string, review_note string, created_at timestamp",
    "env_fields": "id string, case_id string, provider string, data_mode string, coverage string, artifact_uri string, metadata string, created_at timestamp",
    "hindcast_runs": "id string, case_id string, slick_id string, env_field_id string, origin_geom string, release_start timestamp, release_end timestamp, metrics string, config string, artifact_uri string, status string, created_at timestamp",
    "ais_imports": "id string, case_id string, source string, data_mode string, filename string, rows_total long, rows_valid long, rows_quarantined long, quarantine_sample string, time_start timestamp, time_end timestamp, created_at timestamp",
    "ais_positions": "case_id string, import_id string, mmsi long, ts timestamp, ts_epoch double, lon double, lat double, sog double, cog double, heading double, vessel_name string, vessel_type string, length_m double, source string",
    "attribution_runs": "id string, case_id string, hindcast_run_id string, weights string, summary string, created_at timestamp",
    "vessel_scores": "id string, attribution_run_id string, case_id string, mmsi long, rank long, score double, priority string, factors string, evidence string, limitations string, vessel string, track string, review_status string, review_note string",
    "jobs": "id string, case_id string, kind string, state string, progress double, message string, result string, error string, created_at timestamp, updated_at timestamp",
    "audit_log": "case_id string, ts timestamp, actor string, action string, detail string",
}
#: Tables whose rows belong to a case and go with it.
CASE_TABLES = tuple(t for t in TABLES if t != "cases")


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])
