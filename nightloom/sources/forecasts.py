"""A forecast service as a data source: ``spark.read.format("forecasts")``, backed by files of recorded answers.

Answers are JSON lines in folders model=.../shelf=..., a line for each try: cell, attempt, status, reason, hourly (parallel
arrays). A partition is a shelf of a model, so a shelf's cells are fetched in one task, one cell after another. The variables
asked for are an option, as the service counts a request by them.

With the option pushdown=once, filters on model and cell go into the source: shelves that can't match are no partitions, and
cells that don't are not fetched. Spark plans such a frame's partitions once, by the first query over it, so it is for one query;
without the option a frame may be filtered again and again, and Spark does all the filtering.

A cell is tried three times: answers of 5xx and 408 are tried again after a pause that grows, 429 and other 4xx are not.
Failures are rows of the outcomes, never errors, so one cell doesn't stop a fetch.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

#: Tries of a cell, seconds between them (times the number of the try), shelves of a model.
TRIES, PAUSE, SHELVES = 3, 0.0, 16
VARIABLES = ("cloud_cover",)
KINDS = ("daily", "hourly", "minutely")
#: What the reader hands to Spark: hours of forecasts, or one row for each cell's fetch.
HOURS, OUTCOMES = "hours", "outcomes"


def limit_kind(reason: str | None) -> str:
    """Which limit an answer of 429 speaks of; unknown if none is named."""
    text = (reason or "").lower()
    return next((k for k in KINDS if k in text), "unknown")


class Outcome(NamedTuple):
    hourly: dict | None
    attempts: int
    reason: str | None
    limited: str | None  # the kind of limit


def fetched(answers: Iterator[dict], tries: int = TRIES, pause: float = PAUSE, sleep=time.sleep) -> Outcome:
    """What becomes of a cell whose tries get these answers, in order; a try without an answer is a connection that failed."""
    for attempt in range(1, tries + 1):
        answer = next(answers, None)
        status = answer["status"] if answer else None
        if status == 200:
            return Outcome(answer["hourly"], attempt, None, None)
        if status == 429:
            kind = limit_kind(answer.get("reason"))
            return Outcome(None, attempt, f"HTTP 429 ({kind})", kind)
        if status is not None and 400 <= status < 500 and status != 408:
            return Outcome(None, attempt, f"client_error (HTTP {status})", None)
        reason = "connection" if status is None else f"HTTP {status}"
        if attempt < tries and pause:
            sleep(pause * attempt)
    return Outcome(None, tries, reason, None)


class Shelf(InputPartition):
    def __init__(self, model: int, files: list[str]):
        self.model, self.files = model, files


class Forecasts(DataSource):
    """Options: path; what (hours or outcomes); variables (comma-separated); tries; pause (seconds); shelves; pushdown."""

    @classmethod
    def name(cls) -> str:
        return "forecasts"

    def variables(self) -> list[str]:
        return [v.strip() for v in self.options.get("variables", ",".join(VARIABLES)).split(",") if v.strip()]

    def schema(self) -> str:
        if self.options.get("what", HOURS) == OUTCOMES:
            return "model int, cell long, ok boolean, attempts int, reason string, limited string, hours int"
        return "model int, cell long, time string, " + ", ".join(f"{v} double" for v in self.variables())

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options, self.variables())


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], variables: list[str]):
        self.path, self.what, self.variables = options["path"], options.get("what", HOURS), variables
        self.tries, self.pause, self.shelves = int(options.get("tries", TRIES)), float(options.get("pause", PAUSE)), int(options.get("shelves", SHELVES))
        self.once = options.get("pushdown") == "once"
        self.models: set[int] | None = None
        self.cells: set[int] | None = None

    def pushFilters(self, filters):
        """Equalities on model and cell are the source's, if it may push; Spark keeps the rest."""
        for f in filters:
            if not self.once:
                yield f
                continue
            name = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else set()
            if name == "model":
                self.models = values if self.models is None else self.models & values
            elif name == "cell":
                self.cells = values if self.cells is None else self.cells & values
            else:
                yield f

    def opened(self) -> tuple[pyarrow.fs.FileSystem, str]:
        if "://" in self.path or self.path.startswith("file:"):
            return pyarrow.fs.FileSystem.from_uri(self.path if "://" in self.path else self.path.replace("file:/", "file:///", 1))
        return pyarrow.fs.LocalFileSystem(), self.path

    def partitions(self) -> list[Shelf]:
        files, root = self.opened()
        wanted = None if self.cells is None else {c % self.shelves for c in self.cells}
        shelves: dict[tuple[int, int], list[str]] = {}
        for info in files.get_file_info(pyarrow.fs.FileSelector(root, recursive=True)):
            name = info.path.rsplit("/", 1)[-1]
            if info.is_file and not name.startswith(("_", ".")):
                keys = dict(p.split("=", 1) for p in info.path.split("/") if "=" in p)
                model, shelf = int(keys["model"]), int(keys["shelf"])
                if (self.models is None or model in self.models) and (wanted is None or shelf in wanted):
                    shelves.setdefault((model, shelf), []).append(info.path)
        return [Shelf(model, sorted(paths)) for (model, _), paths in sorted(shelves.items())]

    def answers(self, partition: Shelf) -> Iterator[tuple[int, list[dict]]]:
        """(cell, its answers in order): a cell's lines stand together."""
        files, _ = self.opened()
        for path in partition.files:
            cell, held = None, []
            with files.open_input_stream(path) as stream:
                for line in _lines(stream):
                    answer = json.loads(line)
                    if answer["cell"] != cell:
                        if held:
                            yield cell, held
                        cell, held = answer["cell"], []
                    held.append(answer)
            if held:
                yield cell, held

    def read(self, partition: Shelf) -> Iterator[tuple]:
        for cell, answers in self.answers(partition):
            if self.cells is not None and cell not in self.cells:
                continue
            got = fetched(iter(sorted(answers, key=lambda a: a["attempt"])), self.tries, self.pause)
            times = (got.hourly or {}).get("time", [])
            if self.what == OUTCOMES:
                yield partition.model, cell, got.hourly is not None, got.attempts, got.reason, got.limited, len(times)
                continue
            columns = [(got.hourly or {}).get(v) or [] for v in self.variables]
            for i, t in enumerate(times):
                yield partition.model, cell, t, *(float(c[i]) if i < len(c) and c[i] is not None else None for c in columns)


def _lines(stream, size: int = 1 << 20) -> Iterator[str]:
    rest = b""
    while block := stream.read(size):
        *whole, rest = (rest + block).split(b"\n")
        yield from (x.decode() for x in whole if x)
    if rest:
        yield rest.decode()


def write_answers(answers: DataFrame, path: str, shelves: int = SHELVES) -> None:
    """Answers (model, cell, attempt, status, reason, hourly) as the files of the source: a shelf's cells in a file, in order."""
    rows = answers.withColumn("shelf", F.pmod("cell", F.lit(shelves)).cast("int"))
    rows.repartition("model", "shelf").sortWithinPartitions("model", "shelf", "cell", "attempt").write.partitionBy("model", "shelf").option("ignoreNullFields", "false").json(path)


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The source over a folder; ``options`` as Forecasts has them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Forecasts)
    return spark.read.format("forecasts").options(path=path, **options).load()
