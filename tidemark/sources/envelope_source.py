"""A pull source: {timestamp, data} messages from a file of lines that a remote side keeps appending to.

Registered with spark.dataSource.register(EnvelopeSource), then spark.readStream.format("envelopes"). The offset is
the number of bytes read, up to the end of a line, so a restarted query resumes where its checkpoint stands. The
driver asks for the length and the last bytes only; each partition asks for its own range of bytes. A server that
knows no ranges is still read right, at the cost of a whole answer for each request.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

TAIL = 1 << 16


class BytesPartition(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class EnvelopeReader(DataSourceStreamReader):
    """Options: url; raw ("true" gives the lines as they are); bytesPerPartition."""

    def __init__(self, options: dict):
        self.url, self.split = options["url"], int(options.get("bytesPerPartition", str(1 << 24)))
        self.raw = options.get("raw", "false").lower() == "true"

    def _bytes(self, start: int, end: int) -> tuple[bytes, int]:
        """The file's bytes start to end, as far as it goes, and its length."""
        request = urllib.request.Request(self.url, headers={"Range": f"bytes={start}-{end - 1}"})
        try:
            with urllib.request.urlopen(request, timeout=30) as answer:
                body = answer.read()
                if answer.status == 206:
                    return body, int(answer.headers["Content-Range"].rpartition("/")[2])
                return body[start:end], len(body)
        except urllib.error.HTTPError as error:
            if error.code != 416:  # nothing from there on
                raise
            return b"", int((error.headers.get("Content-Range") or "*/0").rpartition("/")[2])

    def initialOffset(self) -> dict:
        return {"byte": 0}

    def latestOffset(self) -> dict:
        """Behind the last complete line; a line without its end is still being written."""
        _, length = self._bytes(0, 1)
        end = length
        while end > 0:
            start = max(0, end - TAIL)
            found = self._bytes(start, end)[0].rfind(b"\n")
            if found >= 0:
                return {"byte": start + found + 1}
            end = start
        return {"byte": 0}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [BytesPartition(k, min(k + self.split, end["byte"])) for k in range(start["byte"], end["byte"], self.split)]

    def read(self, partition: BytesPartition) -> Iterator[tuple]:
        """The lines that begin in the partition. Unless raw, a message that is no envelope is passed over; the rest goes on."""
        start, end = partition.start, partition.end
        data = self._bytes(max(0, start - 1), end)[0]
        if start > 0:  # a line that began before belongs to the partition before
            first = data.find(b"\n")
            if first < 0:
                return
            data = data[first + 1 :]
        more = end
        while data and not data.endswith(b"\n"):
            rest, _ = self._bytes(more, more + TAIL)
            if not rest:
                break
            cut = rest.find(b"\n") + 1
            data, more = data + (rest[:cut] if cut else rest), more + len(rest)
        for line in data.decode("utf-8", "replace").split("\n")[:-1] if data.endswith(b"\n") else data.decode("utf-8", "replace").split("\n"):
            if self.raw:
                yield (line,)
                continue
            try:
                message = json.loads(line)
                yield int(message.get("timestamp") or 0), json.dumps(message["data"])
            except (ValueError, KeyError, TypeError, AttributeError):
                continue


class EnvelopeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "envelopes"

    def schema(self) -> str:
        return "value string" if self.options.get("raw", "false").lower() == "true" else "ts_ns long, payload string"

    def streamReader(self, schema) -> EnvelopeReader:
        return EnvelopeReader(self.options)
