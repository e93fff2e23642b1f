"""The live vessel feed as a stream source: ``spark.readStream.format("vessel_feed")``.

A websocket has one reader and can't be asked again, so what comes in is first
appended to a journal on a shared folder.  Offsets count the journal's
messages: a batch that is run again, or a query that starts again from its
checkpoint, reads the journal and then goes on with the socket.
"""

from __future__ import annotations

import base64
import json
import os
import socket
import ssl
import struct
import time
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from tidewake.sources.places import mounted

SCHEMA = "position long, message string"
KINDS = ("PositionReport", "ShipStaticData")


class FeedClosed(ConnectionError):
    """The other side ended the connection."""


class WebSocket:
    """A client of text messages."""

    def __init__(self, url: str, timeout: float = 15.0) -> None:
        at = urlsplit(url)
        secure = at.scheme == "wss"
        self.socket = socket.create_connection((at.hostname, at.port or (443 if secure else 80)), timeout)
        if secure:
            self.socket = ssl.create_default_context().wrap_socket(self.socket, server_hostname=at.hostname)
        key = base64.b64encode(os.urandom(16)).decode()
        path = (at.path or "/") + (f"?{at.query}" if at.query else "")
        ask = f"GET {path} HTTP/1.1\r\nHost: {at.netloc}\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Key: {key}\r\nSec-WebSocket-Version: 13\r\n\r\n"
        self.socket.sendall(ask.encode())
        self.held = b""
        while b"\r\n\r\n" not in self.held:
            self._more()
        head, _, self.held = self.held.partition(b"\r\n\r\n")
        if b" 101 " not in head.split(b"\r\n")[0]:
            raise ConnectionError(f"the feed refused: {head.splitlines()[0].decode('latin-1')}")
        self.parts: list[bytes] = []

    def _more(self) -> None:
        data = self.socket.recv(1 << 16)
        if not data:
            raise FeedClosed("the feed was closed")
        self.held += data

    def send(self, data: bytes, kind: int = 1) -> None:
        mask = os.urandom(4)
        n = len(data)
        size = bytes([128 | n]) if n < 126 else bytes([254]) + struct.pack(">H", n) if n < 65536 else bytes([255]) + struct.pack(">Q", n)
        self.socket.sendall(bytes([128 | kind]) + size + mask + bytes(b ^ mask[i % 4] for i, b in enumerate(data)))

    def _frame(self) -> tuple[int, bool, bytes] | None:
        """The next whole frame of what has come in; None if there is none yet."""
        h = self.held
        if len(h) < 2:
            return None
        n, at = h[1] & 127, 2
        if n > 125:
            width = 2 if n == 126 else 8
            if len(h) < 2 + width:
                return None
            n, at = int.from_bytes(h[2 : 2 + width]), 2 + width
        masked = h[1] >> 7
        if len(h) < at + 4 * masked + n:
            return None
        data = h[at + 4 * masked : at + 4 * masked + n]
        if masked:
            data = bytes(b ^ h[at + i % 4] for i, b in enumerate(data))
        self.held = h[at + 4 * masked + n :]
        return h[0] & 15, bool(h[0] & 128), data

    def next(self, until: float) -> str | None:
        """The next message, or None if none ends before ``until`` (of time.monotonic)."""
        while True:
            while (frame := self._frame()) is None:
                if (left := until - time.monotonic()) <= 0:
                    return None
                self.socket.settimeout(left)
                try:
                    self._more()
                except TimeoutError:
                    return None
            kind, last, data = frame
            if kind == 8:
                raise FeedClosed("the feed was closed")
            if kind == 9:
                self.send(data, 10)
            elif kind in (0, 1, 2):
                self.parts.append(data)
                if last:
                    whole, self.parts = b"".join(self.parts), []
                    return whole.decode("utf-8", "replace")

    def close(self) -> None:
        self.socket.close()


class Journal:
    """Messages as files of lines named by the offset of their first; a file appears whole.

    JSON has line breaks only between its parts, so a message fits in a line.
    """

    def __init__(self, folder: str) -> None:
        self.folder = mounted(folder)
        os.makedirs(self.folder, exist_ok=True)

    def _files(self) -> list[tuple[int, str]]:
        return sorted((int(f.split(".")[0]), os.path.join(self.folder, f)) for f in os.listdir(self.folder) if f.endswith(".jsonl"))

    def append(self, first: int, messages: list[str]) -> None:
        path = os.path.join(self.folder, f"{first:020d}.jsonl")
        with open(path + ".draft", "w", encoding="utf-8", newline="\n") as f:
            f.writelines(" ".join(m.splitlines()) + "\n" for m in messages)
            f.flush()
            os.fsync(f.fileno())
        os.replace(path + ".draft", path)

    def read(self, start: int, end: int | None = None) -> Iterator[tuple[int, str]]:
        for first, path in self._files():
            if end is not None and first >= end:
                return
            with open(path, encoding="utf-8") as f:
                for i, line in enumerate(f, first):
                    if i >= start and (end is None or i < end):
                        yield i, line.rstrip("\n")

    def forget(self, before: int) -> None:
        """Files that lie wholly before an offset go, but for the last."""
        files = self._files()
        for (_, path), (following, _) in zip(files, files[1:], strict=False):
            if following <= before:
                os.unlink(path)


class FeedReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.url, self.poll = options["url"], float(options.get("poll_seconds", 1.0))
        self.most = int(options.get("max_messages", 10_000))
        self.journal, self.keep = Journal(options["journal"]), options.get("keep", "true").lower() == "true"
        west, south, east, north = (float(x) for x in options.get("bbox", "-180,-90,180,90").split(","))
        # The feed itself leaves out what lies outside the box and other kinds of messages.
        self.ask = json.dumps({"APIKey": options.get("key", ""), "BoundingBoxes": [[[south, west], [north, east]]], "FilterMessageTypes": list(KINDS)})
        self.socket: WebSocket | None = None

    def initialOffset(self) -> dict:
        return {"message": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        """What the journal holds from ``start`` on, else what comes in within the polling time."""
        at = start["message"]
        if rows := list(self.journal.read(at)):
            return iter(rows), {"message": at + len(rows)}
        until, fresh = time.monotonic() + self.poll, []
        try:
            if self.socket is None:
                self.socket = WebSocket(self.url)
                self.socket.send(self.ask.encode())
            while len(fresh) < self.most and (message := self.socket.next(until)) is not None:
                fresh.append(message)
        except OSError:
            # A broken connection ends this batch; the next one connects again.
            if self.socket is not None:
                self.socket.close()
            self.socket = None
            time.sleep(max(0.0, min(0.2, until - time.monotonic())))
        if fresh:
            self.journal.append(at, fresh)
        return iter(list(enumerate(fresh, at))), {"message": at + len(fresh)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self.journal.read(start["message"], end["message"])

    def commit(self, end: dict) -> None:
        if not self.keep:
            self.journal.forget(end["message"])


class FeedSource(DataSource):
    """Options: url (ws or wss), journal (a shared folder), bbox "west,south,east,north", key, poll_seconds (1), max_messages (10000), keep (true: the journal stays)."""

    @classmethod
    def name(cls) -> str:
        return "vessel_feed"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> FeedReader:
        return FeedReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeedSource)
