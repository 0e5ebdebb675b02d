"""A file that is still being written as a stream: its offset is the byte up to which it is whole.

    spark.dataSource.register(GrowingFile)
    spark.readStream.format("growing").option("path", p).option("progress", p + ".done").load()

The progress file holds the contiguous watermark; without one the file's size
counts. Rows are (start, data) slices; ``members`` turns them into the members
of a tar that are complete so far.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass
class _Span(InputPartition):
    start: int
    end: int


class _Reader(DataSourceStreamReader):
    def __init__(self, options):
        self.path = options["path"].removeprefix("file://")
        self.progress = options.get("progress")
        self.slice = int(options.get("slice", 4 << 20))

    def _whole(self) -> int:
        size = os.path.getsize(self.path) if os.path.exists(self.path) else 0
        if self.progress and os.path.exists(self.progress):
            with open(self.progress) as f:
                text = f.read().strip()
            return min(size, int(text)) if text.isdigit() else 0
        return size

    def initialOffset(self):
        return {"at": 0}

    def latestOffset(self):
        return {"at": self._whole()}

    def partitions(self, start, end):
        return [_Span(a, min(a + self.slice, end["at"])) for a in range(start["at"], end["at"], self.slice)]

    def read(self, partition):
        with open(self.path, "rb") as f:
            f.seek(partition.start)
            yield (self.path, partition.start, f.read(partition.end - partition.start))

    def commit(self, end):
        pass


class GrowingFile(DataSource):
    @classmethod
    def name(cls):
        return "growing"

    def schema(self):
        return "path string, start long, data binary"

    def streamReader(self, schema):
        return _Reader(self.options)


def _octal(raw: bytes) -> int:
    if raw[:1] == b"\x80":
        return int.from_bytes(raw[1:], "big")
    text = raw.split(b"\0")[0].strip()
    return int(text, 8) if text else 0


def split_tar(data: bytes) -> tuple[list[tuple[str, bytes]], int]:
    """Complete regular members of a plain tar prefix, and how many bytes they took."""
    out, at, name = [], 0, None
    done = 0
    while at + 512 <= len(data):
        h = data[at : at + 512]
        if h == b"\0" * 512:
            at += 512
            done = at
            continue
        size = _octal(h[124:136])
        end = at + 512 + -(-size // 512) * 512
        if end > len(data):
            break
        body, kind = data[at + 512 : at + 512 + size], h[156:157]
        if kind == b"L":
            name = body.rstrip(b"\0").decode("utf-8", "replace")
        elif kind == b"x":
            for line in body.split(b"\n"):
                if b" path=" in line:
                    name = line.split(b"=", 1)[1].decode("utf-8", "replace")
        else:
            if kind in (b"0", b"\0", b"7"):
                prefix = h[345:500].split(b"\0")[0] if h[257:262] == b"ustar" else b""
                own = h[:100].split(b"\0")[0]
                out.append((name or (prefix + b"/" + own if prefix else own).decode("utf-8", "replace"), body))
            name = None
            done = end
        at = end
    return out, done


def _advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rest = bytes(state.get[0]) if state.exists else b""
    rows = pd.concat(list(parts)).sort_values("start")
    data = rest + b"".join(rows["data"])
    members, used = split_tar(data)
    state.update((data[used:],))
    if members:
        yield pd.DataFrame({"path": [key[0]] * len(members), "name": [n for n, _ in members], "content": [c for _, c in members]})


def members(slices: DataFrame) -> DataFrame:
    """path, name, content of tar members as they become complete; an unfinished one waits in the state."""
    return slices.groupBy("path").applyInPandasWithState(_advance, "path string, name string, content binary", "rest binary", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events per type and window with a watermark for late ones, an extension."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
