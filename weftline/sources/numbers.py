"""A streaming source of row numbers, whose offset is the next number."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

NAME = "row_numbers"


class RowNumbers(DataSource):
    """(first, n): runs of row numbers from 0 up to ``rows``, ``batch`` numbers a micro-batch in runs of ``run`` at most.

    Only runs pass through the driver; they are unfolded by tasks.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "first long, n long"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return RunReader(*(int(self.options[k]) for k in ("rows", "batch", "run")))


class RunReader(SimpleDataSourceStreamReader):
    def __init__(self, rows: int, batch: int, run: int):
        self.rows, self.batch, self.run = rows, batch, run

    def initialOffset(self) -> dict:
        return {"row": 0}

    def runs(self, start: int, end: int) -> Iterator[tuple[int, int]]:
        return iter([(a, min(self.run, end - a)) for a in range(start, end, self.run)])  # the engine copies it

    def read(self, start: dict) -> tuple[Iterator[tuple[int, int]], dict]:
        end = max(start["row"], min(self.rows, start["row"] + self.batch))
        return self.runs(start["row"], end), {"row": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[int, int]]:
        return self.runs(start["row"], end["row"])
