"""A Python data source of numbers, split into partitions that are made where they are read."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Span(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SeriesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.low, self.high, self.step = int(options.get("start", 0)), int(options["end"]), int(options.get("step", 1))
        self.count = int(options.get("partitions", 4))
        if self.step < 1 or self.count < 1:
            raise ValueError("step and partitions must be positive")

    def partitions(self) -> list[Span]:
        rows = max(0, -(-(self.high - self.low) // self.step))
        return [Span(rows * k // self.count, rows * (k + 1) // self.count) for k in range(self.count)]

    def read(self, partition: Span) -> Iterator:
        import pyarrow as pa

        for lo in range(partition.low, partition.high, 65_536):
            hi = min(partition.high, lo + 65_536)
            values = [self.low + self.step * k for k in range(lo, hi)]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array([v * v for v in values], pa.int64())], ["n", "square"])


class Series(DataSource):
    """format("series"): start, end (excluded), step and partitions are options."""

    @classmethod
    def name(cls) -> str:
        return "series"

    def schema(self) -> str:
        return "n long, square long"

    def reader(self, schema) -> SeriesReader:
        return SeriesReader(self.options)
