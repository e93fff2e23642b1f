"""The live feed against a small websocket server, state over batches, running counters; and the store's compaction."""

import base64
import hashlib
import json
import os
import socket
import struct
import threading
import time

import pytest
from pyspark.sql import functions as F

from tidewake import config
from tidewake.plans.store import Store, now
from tidewake.sources import fields
from tidewake.streaming import feed, recorder


def position(mmsi, i, name=None):
    return json.dumps({"MessageType": "PositionReport", "MetaData": {"MMSI": mmsi, "ShipName": name or "", "time_utc": f"2026-01-01 00:{i % 60:02d}:00 +0000 UTC"}, "Message": {"PositionReport": {"Latitude": 18.0 + i / 1000, "Longitude": 72.0, "Sog": 5.0, "Cog": 90.0, "TrueHeading": 511.0}}}, indent=1)


def static(mmsi, name):
    return json.dumps({"MessageType": "ShipStaticData", "MetaData": {"MMSI": mmsi, "ShipName": "", "time_utc": "2026-01-01 00:00:00"}, "Message": {"ShipStaticData": {"Name": name, "Type": 80, "Dimension": {"A": 100.0, "B": 20.0}}}})


class Server:
    """Sends each message once, whoever is connected, and notes what it is asked."""

    def __init__(self):
        self.listening = socket.create_server(("127.0.0.1", 0))
        self.url = f"ws://127.0.0.1:{self.listening.getsockname()[1]}/v0/stream"
        self.waiting, self.asked, self.lock = [], [], threading.Condition()
        threading.Thread(target=self._serve, daemon=True).start()

    def say(self, *messages):
        with self.lock:
            self.waiting += messages
            self.lock.notify_all()

    def _serve(self):
        while True:
            try:
                peer, _ = self.listening.accept()
            except OSError:
                return
            threading.Thread(target=self._talk, args=(peer,), daemon=True).start()

    def _talk(self, peer):
        try:
            head = b""
            while b"\r\n\r\n" not in head:
                head += peer.recv(4096)
            key = [x.split(b": ")[1] for x in head.split(b"\r\n") if x.lower().startswith(b"sec-websocket-key")][0]
            accept = base64.b64encode(hashlib.sha1(key + b"258EAFA5-E914-47DA-95CA-C5AB0DC85B11").digest()).decode()
            peer.sendall(f"HTTP/1.1 101 Switching Protocols\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Accept: {accept}\r\n\r\n".encode())
            first = peer.recv(4096)
            n, at = first[1] & 127, 2
            if n == 126:
                n, at = struct.unpack(">H", first[2:4])[0], 4
            self.asked.append(json.loads(bytes(b ^ first[at + i % 4] for i, b in enumerate(first[at + 4 : at + 4 + n]))))
            peer.sendall(b"\x89\x02hi")  # a ping, which wants an answer
            peer.settimeout(0.05)
            while True:
                with self.lock:
                    while not self.waiting:
                        self.lock.wait(0.05)
                        try:
                            if peer.recv(4096) == b"":
                                return
                        except TimeoutError:
                            pass
                    data = self.waiting.pop(0).encode()
                half = len(data) // 2  # in two frames
                for kind, part in ((1, data[:half]), (128, data[half:])):
                    peer.sendall(bytes([kind]) + (bytes([len(part)]) if len(part) < 126 else bytes([126]) + struct.pack(">H", len(part))) + part)
        except OSError:
            pass


def waited(what, seconds=60):
    until = time.monotonic() + seconds
    while not what():
        assert time.monotonic() < until
        time.sleep(0.2)


def test_the_journal(tmp_path):
    j = feed.Journal(str(tmp_path / "j"))
    j.append(0, ["a", '{\n "b": 1}'])
    j.append(2, ["c"])
    j.append(3, ["d", "e"])
    assert list(j.read(1)) == [(1, '{  "b": 1}'), (2, "c"), (3, "d"), (4, "e")] and list(j.read(2, 4)) == [(2, "c"), (3, "d")]
    j.forget(3)
    assert [x for x, _ in j.read(0)] == [3, 4]
    (tmp_path / "j" / "00000000000000000009.jsonl.draft").write_text("half")
    assert [x for x, _ in j.read(0)] == [3, 4]


def test_each_message_once_over_a_restart(spark, tmp_path):
    server = Server()
    journal, out, checkpoint = (str(tmp_path / x) for x in ("journal", "out", "checkpoint"))

    def run():
        feed.register(spark)
        stream = spark.readStream.format("vessel_feed").options(url=server.url, journal=journal, bbox="71,17,73,19", key="k", poll_seconds=0.3).load()
        return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime="200 milliseconds").start()

    def rows():
        try:
            return sorted(r[0] for r in spark.read.parquet(out).select("position").collect())
        except Exception:
            return []

    query = run()
    server.say(*[position(419000001, i) for i in range(5)])
    waited(lambda: len(rows()) == 5)
    query.stop()
    # What came in but was in no batch yet, as after a crash between the journal and the batch.
    feed.Journal(journal).append(5, [position(419000001, 5), position(419000001, 6)])
    query = run()
    server.say(*[position(419000001, i) for i in range(7, 12)])
    waited(lambda: len(rows()) >= 12)
    query.stop()
    assert rows() == list(range(12))
    assert server.asked[0] == {"APIKey": "k", "BoundingBoxes": [[[17.0, 71.0], [19.0, 73.0]]], "FilterMessageTypes": ["PositionReport", "ShipStaticData"]}


def test_a_recording_and_its_counters(spark, tmp_path):
    server = Server()
    seen = recorder.Counters()
    spark.streams.addListener(seen)
    messages = recorder.feed_messages(spark, server.url, str(tmp_path / "journal"), [71, 17, 73, 19], poll_seconds=0.3)
    query = recorder.started(messages, str(tmp_path / "out"), str(tmp_path / "state"), [71, 17, 73, 19], {"processingTime": "200 milliseconds"})
    try:
        server.say(position(1000001, 0), static(1000001, "FIRST"), position(1000001, 1))
        waited(lambda: seen.positions == 2)
        assert seen.read(spark)["vessels"] == 1
        server.say(*[position(1000001 + k, 2 + k) for k in range(4)], static(1000002, "SECOND"))
        waited(lambda: seen.positions == 6)
        got = seen.read(spark)
    finally:
        query.stop()
        spark.streams.removeListener(seen)
    table = spark.read.parquet(str(tmp_path / "out"))
    batch = table.agg(F.count("*").alias("positions"), F.countDistinct("mmsi").alias("vessels"), F.min("ts").alias("time_start"), F.max("ts").alias("time_end")).first().asDict()
    assert got == batch
    names = {(r["mmsi"], r["lat"]): r["vessel_name"] for r in table.collect()}
    # The state of the first batch names the vessel in the second; what came too late does not.
    assert names[1000001, 18.002] == "FIRST" and names[1000002, 18.003] is None


def test_state_over_two_files(spark, tmp_path):
    """A static message in one batch names the positions of the next, in a query that starts again."""
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(" ".join(m.splitlines()) for m in (position(419000007, 0), static(419000007, "NAME"))))
    first = recorder.record(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert first["positions"] == 1
    time.sleep(1.1)
    (folder / "b.json").write_text("\n".join(" ".join(m.splitlines()) for m in (position(419000007, 1), position(419000008, 1))))
    recorder.record(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "cp"))
    rows = {(r["mmsi"], r["lat"]): (r["vessel_name"], r["vessel_type"], r["length_m"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {(419000007, 18.0): (None, None, None), (419000007, 18.001): ("NAME", "tanker", 120.0), (419000008, 18.001): (None, None, None)}


def test_compaction_leaves_one_version(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.most_appends = 12
    s.write("cases", [{"id": f"case_{i}", "name": str(i), "created_at": now()} for i in range(3)])
    held = s.table("cases")
    assert held.count() == 3
    for i in range(11):
        s.update("cases", "case_0", name=f"n{i}")
    assert s.generation("cases") == 1 and len([f for f in os.listdir(tmp_path / "store" / "cases" / "g1") if f.endswith(".parquet")]) == 1
    assert held.count() == 3  # a reader of the generation before
    assert s.get("cases", "case_0")["name"] == "n10" and s._raw("cases").count() == 3
    s.delete("cases", F.col("id") == "case_1")
    s.compact("cases")
    assert s.generation("cases") == 2 and not (tmp_path / "store" / "cases" / "g0").exists()
    assert {r["id"] for r in s.table("cases").collect()} == {"case_0", "case_2"} == {r["id"] for r in Store(spark, str(tmp_path / "store")).table("cases").collect()}
    s.compact("slicks")  # nothing was ever written
    assert s.table("slicks").count() == 0


def test_a_deleted_case_takes_its_files(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    for c in ("case_a", "case_b"):
        folder = tmp_path / "store" / "tiles" / c
        folder.mkdir(parents=True)
        s.write("cases", [{"id": c, "created_at": now()}])
        s.write("scenes", [{"id": f"scene_{c}", "case_id": c, "asset_uri": f"{tmp_path}/store/tiles/{c}", "preview_uri": None, "created_at": now()}])
        s.write("ais_imports", [{"id": f"ais_{c}", "case_id": c, "created_at": now()}])
        s.write("ais_positions", [{"case_id": c, "import_id": f"ais_{c}", "mmsi": 419000001, "ts": now(), "ts_epoch": 0.0, "lon": 1.0, "lat": 1.0}])
    s.delete_case("case_a")
    assert not (tmp_path / "store" / "tiles" / "case_a").exists() and (tmp_path / "store" / "tiles" / "case_b").exists()
    assert not any("case_a" in d for d in os.listdir(s._path("ais_positions"))) and {r["case_id"] for r in s.table("ais_positions").collect()} == {"case_b"}
    with pytest.raises(config.NotFound):
        s.get("cases", "case_a")
    s.compact("ais_positions")
    assert {r["case_id"] for r in s.table("ais_positions").collect()} == {"case_b"}


def test_aligned_over_many_ranges(spark):
    """Ranges without points, points without value and times beyond both ends."""
    points = [(float(t), None if t % 4 == 1 else t * t / 10.0) for t in range(100, 400, 7)] + [(5000.0, 3.0), (5000.0, None)]
    times = [float(t) for t in (0, 99, 100, 101, 107, 250, 399, 1200, 2500, 4999, 5000, 9000)] + [k / 3 for k in range(1400, 3000, 11)]
    got = fields.aligned(spark.createDataFrame(points, "epoch double, value double"), spark.createDataFrame([(t,) for t in times], "epoch double"))
    known = sorted((t, v) for t, v in points if v is not None)
    for r in got.collect():
        before, after = [p for p in known if p[0] <= r["epoch"]], [p for p in known if p[0] > r["epoch"]]
        a, b = before[-1] if before else after[0], after[0] if after else before[-1]
        want = a[1] if a[0] == b[0] else a[1] + (b[1] - a[1]) * (r["epoch"] - a[0]) / (b[0] - a[0])
        assert r["value"] == pytest.approx(want)
    assert got.count() == len(times)
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    none = fields.aligned(spark.createDataFrame([], "epoch double, value double"), spark.createDataFrame([(1.0,)], "epoch double"))
    assert [tuple(r) for r in none.collect()] == [(1.0, None)]
