"""A record of finished calls in a folder that all executors share.

Each task appends the answers of its calls to a file of its own, a JSON object per line, and flushes after each,
so what is lost with a task or a whole run are the calls that were under way. A line that was cut off is ignored when the
journal is read. Files are closed and begun anew every `roll` answers, for stores that show a file only once it is closed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANSWER = "success BOOLEAN, response STRING, reported_prompt_tokens DOUBLE, reported_completion_tokens DOUBLE, latency DOUBLE, total_time DOUBLE"
ENTRY = f"model STRING, pos BIGINT, prompt_md5 STRING, {ANSWER}"


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


@dataclass(frozen=True)
class Journal:
    """The journal of one run below a folder."""

    folder: str
    run_id: str
    roll: int = 1000

    @property
    def path(self) -> str:
        return f"{self.folder.rstrip('/')}/run_id={self.run_id}"

    def entries(self, spark: SparkSession) -> DataFrame:
        """One row per finished call; of several, a successful one."""
        files, base = _opened(self.path)
        if files.get_file_info(base).type == fs.FileType.NotFound:
            return spark.createDataFrame([], ENTRY)
        read = spark.read.schema(f"{ENTRY}, attempt BIGINT").option("mode", "DROPMALFORMED").json(self.path)
        best = F.max_by(F.struct(*[F.col(part.split()[0]) for part in ANSWER.split(", ")]), F.struct("success", -F.col("attempt")))
        found = read.where("model is not null and success is not null").groupBy("model", "pos", "prompt_md5").agg(best.alias("a"))
        return found.select("model", "pos", "prompt_md5", "a.*")

    def writer(self, job: str) -> Writer:
        return Writer(self, job)


class Writer:
    """The journal of one task; knows what earlier attempts at the same partition have finished."""

    def __init__(self, journal: Journal, job: str):
        context = TaskContext.get()
        self.journal, self.attempt = journal, context.taskAttemptId()
        self.files, self.base = _opened(journal.path)
        self.files.create_dir(self.base, recursive=True)
        self.name = f"{job}-{context.partitionId():06d}"
        self.sink, self.number, self.size = None, 0, 0
        self.known = {(e["model"], e["pos"], e["prompt_md5"]): e for e in self._earlier()}

    def _earlier(self) -> Iterator[dict]:
        for info in self.files.get_file_info(fs.FileSelector(self.base)):
            if not info.base_name.startswith(f"{self.name}-"):
                continue
            with self.files.open_input_stream(info.path) as source:
                for line in source.read().splitlines():
                    try:
                        yield json.loads(line)
                    except ValueError:  # the attempt ended while it wrote this
                        continue

    def add(self, model: str, pos: int, prompt_md5: str, answer: dict) -> None:
        if self.sink is None:
            self.sink = self.files.open_output_stream(f"{self.base}/{self.name}-{self.attempt}-{self.number:05d}.json", compression=None)
        entry = {"model": model, "pos": pos, "prompt_md5": prompt_md5, **answer, "attempt": self.attempt}
        self.sink.write(json.dumps(entry).encode() + b"\n")
        self.sink.flush()
        self.size += 1
        if self.size == self.journal.roll:
            self.close()

    def close(self) -> None:
        if self.sink is not None:
            self.sink.close()
            self.sink, self.number, self.size = None, self.number + 1, 0
