"""Ranged remote sources as Spark data sources: the caller brings the loader.

The engine knows no addresses. A loader gives the rows of one range of days, and runs
in tasks: a range of days is a partition, and no body passes through the
driver. As a stream, the days are the offsets, so a run goes on where the one
before ended.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from datetime import date, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: ``loader(options, start, end)``: the rows of ``[start, end)``, in order of the schema.
Loader = Callable[[dict[str, str], date, date], Iterable[Sequence]]


class DayRange(InputPartition):
    def __init__(self, start: date, end: date):
        super().__init__((start.isoformat(), end.isoformat()))
        self.start, self.end = start, end


def day_ranges(start: date, end: date, days: int) -> list[DayRange]:
    """``[start, end)`` in ranges of ``days`` days; the last may be shorter."""
    if days < 1:
        raise ValueError("days must be at least 1")
    return [DayRange(x, min(end, x + timedelta(days))) for x in (start + timedelta(i) for i in range(0, (end - start).days, days))]


def _day(options: dict[str, str], name: str) -> date:
    if name not in options:
        raise ValueError(f"option {name} is missing")
    return date.fromisoformat(options[name])


def ranged_source(name: str, schema: str, loader: Loader, until: Callable[[dict[str, str]], date] | None = None) -> type[DataSource]:
    """A source to register with ``spark.dataSource.register``, then ``spark.read.format(name)``.

    Options: ``start``, ``end`` (ISO days, half-open; a stream has ``start`` only), ``days``
    for the days of a partition (30), and any that the loader takes. ``until`` tells a
    stream the day up to which there are rows. A loader's ``OSError`` and rows that
    do not fit the schema's width fail the job with the range that they belong to."""

    def rows(options: dict[str, str], part: DayRange) -> Iterator[tuple]:
        at = f"{part.start} to {part.end}"
        try:
            for row in loader(options, part.start, part.end):
                if not isinstance(row, (tuple, list)):
                    raise RuntimeError(f"{name}, {at}: not a row: {row!r}")
                yield tuple(row)
        except OSError as e:
            raise RuntimeError(f"{name}, {at}: request failed: {e}") from e
        except ValueError as e:
            raise RuntimeError(f"{name}, {at}: the answer cannot be read: {e}") from e

    class Reader(DataSourceReader):
        def __init__(self, options: dict[str, str]):
            self.options = options

        def partitions(self) -> Sequence[InputPartition]:
            start, end = _day(self.options, "start"), _day(self.options, "end")
            if start > end:
                raise ValueError("start lies after end")
            return day_ranges(start, end, int(self.options.get("days", 30))) or [DayRange(start, start)]

        def read(self, partition: DayRange) -> Iterator[tuple]:
            return rows(self.options, partition) if partition.start < partition.end else iter(())

    class StreamReader(DataSourceStreamReader):
        def __init__(self, options: dict[str, str]):
            self.options = options

        def initialOffset(self) -> dict:
            return {"day": _day(self.options, "start").isoformat()}

        def latestOffset(self) -> dict:
            return {"day": max(_day(self.options, "start"), until(self.options)).isoformat()}

        def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
            return day_ranges(date.fromisoformat(start["day"]), date.fromisoformat(end["day"]), int(self.options.get("days", 30)))

        def read(self, partition: DayRange) -> Iterator[tuple]:
            return rows(self.options, partition)

        def commit(self, end: dict) -> None:
            pass

    class Ranged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Reader(dict(self.options))

        def streamReader(self, schema) -> DataSourceStreamReader:
            if until is None:
                raise ValueError(f"{name} is no stream: it was made without until")
            return StreamReader(dict(self.options))

    return Ranged
