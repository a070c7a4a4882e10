"""Probe answers as a data source, and server-sent frames as a sink.

spark.dataSource.register(ProbeAnswers) makes the format "probe_answers" for read and readStream: a folder of JSON lines, a file
for each round of polls, in the order of the files' names. A line is one answer: {"id", "createdMs", "tsMs", "status", "results"}.
Files are read by the executors, some for each partition; the driver lists names only. A stream's offset is the name of the last
file that it has read, so it goes on there after a restart; a new file's name must come after those that are there.

spark.dataSource.register(Frames) makes the format "frames" for writeStream: a column frame, written to a folder with one
subfolder for each micro-batch, which appears at once or not at all. A batch that is run again is not written again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

from pathloom.streaming.live import DEADLINE_MS

ANSWER = "measurement_id string, poll string, ts_ms long, status string, n_hops int, payload string"


@dataclass
class Files(InputPartition):
    names: list[str]


def _names(path: str) -> list[str]:
    """The names of a folder's JSON-lines files, in order."""
    store, folder = fs.FileSystem.from_uri(path)
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.File and f.base_name.endswith(".jsonl"))


def answer_row(line: str, poll: str, deadline_ms: int) -> tuple | None:
    """A row of one answer; None for a line that is none.

    Of its results only the first counts: payload is its JSON, n_hops the number of hops in it. An answer that comes after its
    measurement's deadline says so and shows nothing.
    """
    try:
        a = json.loads(line)
    except ValueError:
        return None
    if not isinstance(a, dict) or not isinstance(a.get("id"), str) or not isinstance(a.get("tsMs"), int):
        return None
    created, results = a.get("createdMs"), a.get("results")
    if isinstance(created, int) and a["tsMs"] > created + deadline_ms:
        return a["id"], poll, a["tsMs"], "deadline", 0, None
    first = results[0] if isinstance(results, list) and results else None
    inner = first.get("result") if isinstance(first, dict) else None
    hops = inner.get("hops") if isinstance(inner, dict) else None
    status = a.get("status")
    return a["id"], poll, a["tsMs"], status if isinstance(status, str) else None, len(hops) if isinstance(hops, list) else 0, None if first is None else json.dumps(first)


class _Answers:
    """What batch and stream share."""

    def __init__(self, options: dict):
        self.path, self.deadline = options["path"], int(options.get("deadlinems", DEADLINE_MS))
        self.each = int(options.get("filesperpartition", 8))

    def split(self, names: list[str]) -> list[Files]:
        return [Files(names[i : i + self.each]) for i in range(0, len(names), self.each)]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, folder = fs.FileSystem.from_uri(self.path)
        for name in partition.names:
            with store.open_input_stream(f"{folder}/{name}") as f:
                rest = b""
                while block := f.read(1 << 20):
                    *lines, rest = (rest + block).split(b"\n")
                    yield from filter(None, (answer_row(x.decode("utf-8", "replace"), name, self.deadline) for x in lines if x))
                if rest:
                    yield from filter(None, [answer_row(rest.decode("utf-8", "replace"), name, self.deadline)])


class _Batch(_Answers, DataSourceReader):
    def partitions(self) -> list[Files]:
        return self.split(_names(self.path)) or [Files([])]


class _Stream(_Answers, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max(_names(self.path), default="")}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return self.split([n for n in _names(self.path) if start["after"] < n <= end["after"]])

    def commit(self, end: dict) -> None:
        pass


class ProbeAnswers(DataSource):
    """Options: path; deadlineMs, after which an answer shows nothing (DEADLINE_MS); filesPerPartition (8)."""

    @classmethod
    def name(cls) -> str:
        return "probe_answers"

    def schema(self) -> str:
        return ANSWER

    def _options(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self._options())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self._options())


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class _FrameWriter(DataSourceStreamWriter):
    """Tasks write hidden files; a commit gathers them in a hidden folder and moves that to its place in one step."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> Written:
        store, folder = fs.FileSystem.from_uri(self.path)
        name, out = f"{folder}/.pending/{uuid.uuid4().hex}.sse", None
        try:
            for row in iterator:
                if row.frame is None:
                    continue
                if out is None:
                    store.create_dir(f"{folder}/.pending", recursive=True)
                    out = store.open_output_stream(name)
                out.write(row.frame.encode())
        finally:
            if out is not None:
                out.close()
        return Written(name if out is not None else None)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        store, folder = fs.FileSystem.from_uri(self.path)
        place, names = f"{folder}/batch={batchId:09d}", [m.name for m in messages if m is not None and m.name]
        if store.get_file_info(place).type != fs.FileType.NotFound:
            self._drop(store, names)  # this batch has been written before
            return
        own = f"{folder}/.pending/{uuid.uuid4().hex}"
        store.create_dir(own, recursive=True)
        for i, name in enumerate(names):
            store.move(name, f"{own}/part-{i:05d}.sse")
        store.move(own, place)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        store, _ = fs.FileSystem.from_uri(self.path)
        self._drop(store, [m.name for m in messages if m is not None and m.name])

    @staticmethod
    def _drop(store, names: list[str]) -> None:
        for name in names:
            if store.get_file_info(name).type == fs.FileType.File:
                store.delete_file(name)


class Frames(DataSource):
    """Option: path. The rows have a text column frame; null frames are left out."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return _FrameWriter({k.lower(): v for k, v in self.options.items()}["path"])
