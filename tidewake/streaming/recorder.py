"""Recording live vessel messages: position reports joined with the vessel's latest static data."""

from __future__ import annotations

from collections.abc import Iterator
from threading import Lock

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from tidewake.sources.registry import ship_type_label
from tidewake.streaming import feed

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

MESSAGES = (
    "MessageType string, error string, MetaData struct<MMSI: long, ShipName: string, time_utc: string>, "
    "Message struct<PositionReport: struct<Latitude: double, Longitude: double, Sog: double, Cog: double, TrueHeading: double>, "
    "ShipStaticData: struct<Name: string, Type: long, Dimension: struct<A: double, B: double>>>"
)
ROUTED = "mmsi long, kind string, ts timestamp, lon double, lat double, sog double, cog double, heading double, vessel_name string, vessel_type string, length_m double"
POSITIONS = "mmsi long, ts timestamp, lon double, lat double, sog double, cog double, heading double, vessel_name string, vessel_type string, length_m double"


def arrived() -> Column:
    """When and where in its folder a message was dropped; sorts in the order of arrival."""
    at, block = (F.lpad(c.cast("string"), 18, "0") for c in (F.unix_micros("_metadata.file_modification_time"), F.col("_metadata.file_block_start")))
    return F.concat_ws(" ", at, "_metadata.file_name", block)


def read_messages(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """JSON lines that a bridge from the live feed drops into a folder, with their order of arrival.

    A batch takes all files that are there, unless ``max_files`` is given:
    every batch costs a visit to the state of every vessel in it.
    """
    reader = spark.readStream.schema(MESSAGES)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(folder).withColumn("arrived", arrived())


def routed(messages: DataFrame, bbox: list[float] | None = None) -> DataFrame:
    """Usable position reports and static messages in one shape.

    Messages without a vessel number go, and reports off the map or at (0, 0).
    Speeds from 102.3 and courses from 360 mean "unknown".  A time that can't
    be read becomes the present.  An error message stops the query.
    """
    checked = messages.withColumn("MessageType", F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("feed error: "), "error")).cast("string")).otherwise(F.col("MessageType")))
    name = F.nullif(F.trim(F.col("MetaData.ShipName")), F.lit(""))
    p, s = F.col("Message.PositionReport"), F.col("Message.ShipStaticData")
    ts = F.coalesce(F.try_to_timestamp(F.regexp_replace(F.substring("MetaData.time_utc", 1, 19), " ", "T")), F.current_timestamp())
    static = F.col("MessageType") == "ShipStaticData"
    lon, lat = F.coalesce(p["Longitude"], F.lit(0.0)), F.coalesce(p["Latitude"], F.lit(0.0))

    def below(x, limit: float):
        return F.when(x < limit, x)

    order = [F.col("arrived")] if "arrived" in messages.columns else []
    out = checked.where((F.col("MetaData.MMSI") != 0) & F.col("MessageType").isin("ShipStaticData", "PositionReport")).select(
        F.col("MetaData.MMSI").alias("mmsi"), F.when(static, "static").otherwise("position").alias("kind"), ts.alias("ts"), F.when(~static, lon).alias("lon"), F.when(~static, lat).alias("lat"),
        below(p["Sog"], 102.3).alias("sog"), below(p["Cog"], 360).alias("cog"), below(p["TrueHeading"], 360).alias("heading"),
        F.when(static, F.coalesce(F.nullif(F.trim(s["Name"]), F.lit("")), name)).otherwise(name).alias("vessel_name"), ship_type_label(s["Type"]).alias("vessel_type"),
        F.nullif(F.coalesce(s["Dimension"]["A"], F.lit(0.0)) + F.coalesce(s["Dimension"]["B"], F.lit(0.0)), F.lit(0.0)).alias("length_m"), *order,
    )
    on_map = F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90) & ~((F.col("lon") == 0) & (F.col("lat") == 0))
    if bbox:
        on_map &= F.col("lon").between(bbox[0], bbox[2]) & F.col("lat").between(bbox[1], bbox[3])
    return out.where((F.col("kind") == "static") | on_map)


_STATIC = ("vessel_name", "vessel_type", "length_m")


def in_order(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A vessel's messages of a batch as they arrived, if that is known.

    Only where static messages are among them does order matter; then the
    vessel's messages of the batch are sorted together.
    """
    first = next(frames, None)
    if first is None or "arrived" not in first.columns:
        yield from () if first is None else (first,)
        yield from frames
        return
    held = [first, *frames]
    if any((f["kind"] == "static").any() for f in held):
        held = [pd.concat(held).sort_values("arrived", kind="stable", ignore_index=True)]
    yield from held


class StaticData(StatefulProcessor):
    """Each vessel's last static message, as a value of the state store; positions get what came before them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("static_data", "vessel_name string, vessel_type string, length_m double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        held = tuple(self.known.get()) if self.known.exists() else (None, None, None)
        changed = False
        for frame in in_order(iter(rows)):
            static = (frame["kind"] == "static").to_numpy()
            # For each row the last static message before it in the frame; before the first one, the state.
            last = np.maximum.accumulate(np.where(static, np.arange(len(frame)), -1))
            own = frame["vessel_name"]
            for c, before in zip(_STATIC, held, strict=True):
                seen = frame[c].astype(object).to_numpy()
                frame[c] = pd.Series(np.where(last >= 0, seen[last], before), index=frame.index, dtype=object)
            frame["vessel_name"] = frame["vessel_name"].where(frame["vessel_name"].notna(), own)
            if static.any():
                held, changed = tuple(None if pd.isna(x) else x for x in frame.loc[frame.index[last[-1]], list(_STATIC)]), True
            out = frame.loc[~static, ["mmsi", "ts", "lon", "lat", "sog", "cog", "heading", *_STATIC]]
            if len(out):
                out = out.astype({c: "float64" for c in ("lon", "lat", "sog", "cog", "heading", "length_m")})
                yield out.assign(**{c: out[c].where(out[c].notna(), None) for c in _STATIC[:2]})
        if changed:
            self.known.update(held)

    def close(self) -> None:
        pass


def enriched(rows: DataFrame, watermark: str | None = None) -> DataFrame:
    """Positions with the static data that was seen before them, held as state by vessel in RocksDB.

    Late and repeated reports are kept, unless a watermark is asked for.
    """
    if watermark:
        rows = rows.withWatermark("ts", watermark)
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return rows.groupBy("mmsi").transformWithStateInPandas(StaticData(), POSITIONS, "append", "none")


class Counters(StreamingQueryListener):
    """Numbers of a running recording, added up from what its batches report.

    Vessels are counted by sketches that can be merged, so neither the vessels
    nor their positions are held.
    """

    NAME = "recorded"

    def __init__(self) -> None:
        self.positions, self.batches = 0, 0
        self.first = self.last = None
        self.sketches: list[bytes] = []
        self._lock = Lock()

    @classmethod
    def watching(cls, positions: DataFrame) -> DataFrame:
        """``positions`` with what each batch reports."""
        return positions.observe(cls.NAME, F.count(F.lit(1)).alias("positions"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.hll_sketch_agg("mmsi").alias("vessels"))

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.NAME)
        if seen is None or not seen["positions"]:
            return
        with self._lock:
            self.batches += 1
            self.positions += seen["positions"]
            self.first = min(filter(None, (self.first, seen["first"])))
            self.last = max(filter(None, (self.last, seen["last"])))
            self.sketches.append(bytes(seen["vessels"]))

    def read(self, spark: SparkSession) -> dict:
        """The numbers so far."""
        with self._lock:
            held, out = list(self.sketches), {"positions": self.positions, "time_start": self.first, "time_end": self.last}
        if not held:
            return out | {"vessels": 0}
        merged = spark.createDataFrame([(bytearray(x),) for x in held], "s binary").agg(F.hll_union_agg("s").alias("s")).select("s", F.hll_sketch_estimate("s").alias("n")).first()
        with self._lock:  # one sketch instead of those that were merged
            self.sketches = [bytes(merged["s"]), *self.sketches[len(held) :]]
        return out | {"vessels": merged["n"]}


def latest_static(messages: DataFrame) -> DataFrame:
    """The last static message of every vessel in a batch of messages."""
    rows = routed(messages).where("kind = 'static'")
    return rows.groupBy("mmsi").agg(*[F.max_by(c, "ts").alias(f"s_{c}") for c in ("vessel_name", "vessel_type", "length_m")])


def backfilled(positions: DataFrame, static: DataFrame) -> DataFrame:
    """Missing names, types and lengths filled from static data that came later."""
    out = positions.join(static, "mmsi", "left")
    for c in ("vessel_name", "vessel_type", "length_m"):
        out = out.withColumn(c, F.coalesce(c, f"s_{c}"))
    return out.select(*positions.columns)


def feed_messages(spark: SparkSession, url: str, journal: str, bbox: list[float] | None = None, key: str = "", **options: object) -> DataFrame:
    """Messages of the live feed, parsed; the box is asked of the feed."""
    feed.register(spark)
    known = {"url": url, "journal": journal, "key": key} | ({"bbox": ",".join(map(str, bbox))} if bbox else {})
    raw = spark.readStream.format("vessel_feed").options(**known, **options).load()
    return raw.select(F.from_json("message", MESSAGES).alias("m")).select("m.*")


def started(messages: DataFrame, out: str, checkpoint: str, bbox: list[float] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """A running recording of enriched positions as Parquet."""
    positions = Counters.watching(enriched(routed(messages, bbox)))
    writer = positions.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def record(spark: SparkSession, folder: str, out: str, checkpoint: str, minutes: float | None = None, bbox: list[float] | None = None, counters: Counters | None = None, url: str | None = None, key: str = "") -> dict:
    """Writes enriched positions as Parquet for so many minutes, or once through all files, and sums up.

    Messages are JSON files of ``folder``; with ``url`` they come from the live
    feed, whose journal is kept there.  ``counters`` can be read meanwhile.
    """
    if minutes is not None and not 1 <= minutes <= 240:
        raise ValueError("minutes must lie in [1, 240]")
    if url and minutes is None:
        raise ValueError("a live feed has no end: give minutes")
    messages = feed_messages(spark, url, folder, bbox, key) if url else read_messages(spark, folder)
    if counters is not None:
        spark.streams.addListener(counters)
    query = started(messages, out, checkpoint, bbox, None if minutes is None else {"processingTime": "5 seconds"})
    try:
        query.awaitTermination(None if minutes is None else int(minutes * 60))
    finally:
        query.stop()
        if counters is not None:
            spark.streams.removeListener(counters)
    static = latest_static(spark.read.schema(MESSAGES).json(folder))
    positions = backfilled(spark.read.schema(POSITIONS).parquet(out), static)
    r = positions.agg(F.count("*").alias("positions"), F.countDistinct("mmsi").alias("vessels"), F.min("ts").alias("time_start"), F.max("ts").alias("time_end")).first()
    return r.asDict() | {"static_vessels": static.count(), "data_mode": "real", "positions_frame": positions}
