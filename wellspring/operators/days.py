"""Daily rows as arrays: a series' days are made, used and summed up in one place and never become rows between.

A daily table is some 200 times as long as its readings, and nearly all that is asked of it
are sums by series. So ``Days`` keeps the readings of a series in one row, next to the steps
that make daily columns of them; ``partial`` runs the steps over blocks of some series and gives
what a function returns for each block. A column is made when it is first asked for.

A task holds one batch of readings, the days of a block and the weather of its cells. Weather comes ahead of the
series of its cell, in pieces of a year, so that neither a cell's members nor its calendar
has to fit in a row. NULL numbers are NaN in the arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Values of a column of results that are gathered before they are handed on.
FLUSH_VALUES = 1 << 15
# Days of the series that are worked on at once: enough to outweigh a call, few enough to stay in a cache.
BLOCK_DAYS = 1 << 15
# Days by which the calendar tables are longer than what is asked for.
SPARE_DAYS = 4096


class _Calendar:
    """Month, day of the month, day of the year and year of consecutive days."""

    first, size = 0, 0
    tables: dict[str, np.ndarray] = {}

    @classmethod
    def of(cls, days: np.ndarray, name: str) -> np.ndarray:
        if not len(days):
            return np.zeros(0, np.int64)
        low, high = int(days.min()), int(days.max()) + 1
        if low < cls.first or high > cls.first + cls.size:
            if cls.size:
                low, high = min(low, cls.first), max(high, cls.first + cls.size)
            cls._grow(low - SPARE_DAYS, high + SPARE_DAYS)
        return cls.tables[name][days - cls.first]

    @classmethod
    def _grow(cls, low: int, high: int) -> None:
        day = np.datetime64("1970-01-01", "D") + np.arange(low, high)
        month, year = day.astype("M8[M]"), day.astype("M8[Y]")
        cls.first, cls.size = low, high - low
        cls.tables = {
            "year": year.astype(np.int64) + 1970,
            "month": month.astype(np.int64) % 12 + 1,
            "dom": (day - month).astype(np.int64) + 1,
            "doy": (day - year).astype(np.int64) + 1,
        }


calendar_of = _Calendar.of


class Cell:
    """Weather of one cell, laid out by day as far as it is known."""

    def __init__(self, key: str | None, names: list[str]):
        self.key, self.names, self.pieces, self.laid = key, names, [], False

    def add(self, days: np.ndarray, values: list[np.ndarray]) -> None:
        if len(days):
            self.pieces.append((days, values))
            self.laid = False

    def _lay(self) -> None:
        self.first = min(int(d.min()) for d, _ in self.pieces)
        n = max(int(d.max()) for d, _ in self.pieces) + 1 - self.first
        self.given = np.zeros(n, bool)
        self.columns = {c: np.full(n, np.nan) for c in self.names}
        for days, values in self.pieces:
            self.given[days - self.first] = True
            for c, v in zip(self.names, values):
                self.columns[c][days - self.first] = v
        self.laid = True

    def fill(self, out: np.ndarray, name: str | None, first: int) -> None:
        """Lay a column from day ``first`` on over ``out``; without a name, whether there is a row."""
        if not self.pieces:
            return
        if not self.laid:
            self._lay()
        have = self.given if name is None else self.columns[name]
        low, high = max(first, self.first), min(first + len(out), self.first + len(have))
        if low < high:
            out[low - first : high - first] = have[low - self.first : high - self.first]


@dataclass(frozen=True)
class One:
    """Readings of one series, sorted; of a series that lies ``again`` in its cell one more."""

    key: str
    cell: Cell
    again: bool
    depth: float
    days: np.ndarray
    levels: np.ndarray


class Block(dict):
    """Daily columns of some series, end to end; a column is made when it is first asked for.

    Series ``i`` holds ``n[i]`` days without gaps from ``first[i]`` on, at ``starts[i]``.
    ``kept`` says which days steps have left.
    """

    def __init__(self, series: list[One]):
        super().__init__()
        self.made: dict[str, Callable[[Block], np.ndarray]] = {
            "_at": lambda b: np.arange(b.size),
            "_begin": lambda b: b.per_day(b.starts),
            "_place": lambda b: b["_at"] - b["_begin"],
            "date": lambda b: b["_at"] + b.per_day(b.first - b.starts),
            **{c: lambda b, c=c: calendar_of(b["date"], c) for c in ("year", "month", "dom", "doy")},
        }
        self.series, self.size = series, 0

    def span(self, series: list[One], first: np.ndarray, n: np.ndarray) -> None:
        self.series, self.first, self.n = series, first, n
        ends = np.cumsum(n)
        self.starts, self.size = ends - n, int(ends[-1]) if len(n) else 0
        self.kept = np.ones(self.size, bool)

    def __missing__(self, name: str) -> np.ndarray:
        self[name] = out = self.made[name](self)
        return out

    def per_day(self, values: np.ndarray) -> np.ndarray:
        return np.repeat(values, self.n)

    def weather(self, name: str | None) -> np.ndarray:
        out = np.zeros(self.size, bool) if name is None else np.full(self.size, np.nan)
        for one, first, start, n in zip(self.series, self.first.tolist(), self.starts.tolist(), self.n.tolist()):
            one.cell.fill(out[start : start + n], name, first)
        return out

    def head(self, days: int) -> np.ndarray:
        """Places of the first days of each series."""
        if (name := f"_head_{days}") not in self:
            self[name] = np.flatnonzero(self["_place"] < days)
        return self[name]

    def lagged(self, x: np.ndarray, days: int) -> np.ndarray:
        """The value some days before in the same series; of negative days the one after."""
        out = np.empty(len(x))
        if days >= 0:
            out[days:] = x[: max(len(x) - days, 0)]
            out[self.head(days)] = np.nan
        else:
            out[:days] = x[-days:]
            out[self["_place"] >= self.per_day(self.n + days)] = np.nan
        return out

    def running(self, x: np.ndarray) -> np.ndarray:
        """Running total of each series."""
        total = np.cumsum(x)
        return total - self.per_day(total[self.starts] - x[self.starts])

    def runs(self, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a new series or a new value of a column begins, and the series of each such run."""
        new = np.empty(self.size, bool)
        new[1:] = column[1:] != column[:-1]
        new[self.starts] = True
        begins = np.flatnonzero(new)
        return begins, np.searchsorted(self.starts, begins, "right") - 1


def half_even(x: np.ndarray, places: int) -> np.ndarray:
    """``functions.numeric.half_even`` of an array."""
    return np.rint(x * 10.0**places) / 10.0**places


Step = Callable[[Block], None]
Answer = dict[str, np.ndarray]


@dataclass(frozen=True)
class Days:
    """Series with their readings, the steps that make daily columns, and the weather to lie beside them."""

    series: DataFrame
    steps: tuple[Step, ...] = ()
    weather: DataFrame | None = None
    names: tuple[str, ...] = ()

    def then(self, step: Step) -> Days:
        return replace(self, steps=(*self.steps, step))

    def beside(self, weather: DataFrame, names: list[str]) -> Days:
        return replace(self, weather=weather, names=tuple(names))

    def _laid(self) -> DataFrame:
        """Rows in the order that a task reads them: a cell's weather by year, then its series."""
        width = max(len(self.names), 1)
        numbers = "array<double>"
        series = self.series.select(
            "cell_id", "well_id", F.lit(1).alias("_kind"), F.lit(0).alias("_year"), "copies", "depth",
            F.col("_readings.d").alias("_d"), F.col("_readings.v").alias("_0"), *[F.lit(None).cast(numbers).alias(f"_{i}") for i in range(1, width)],
        )
        tasks = 2 * int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        if self.weather is not None:
            known = self.weather.where(F.col("cell_id").isNotNull() & F.col("date").isNotNull())
            values = [F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(self.names)]
            years = known.groupBy("cell_id", F.year("date").alias("_year")).agg(
                F.sort_array(F.collect_list(F.struct(F.unix_date("date").alias("d"), *values))).alias("_w")
            )
            pieces = years.select(
                "cell_id", F.lit(None).cast("string").alias("well_id"), F.lit(0).alias("_kind"), "_year", F.lit(0).cast("long").alias("copies"),
                F.lit(None).cast("double").alias("depth"), F.col("_w.d").alias("_d"), *[F.col(f"_w._{i}").alias(f"_{i}") for i in range(width)],
            )
            series = pieces.unionByName(series)
        # Series of no cell meet no weather, so they need not lie together.
        laid = series.repartition(tasks, F.coalesce("cell_id", "well_id"))
        return laid.sortWithinPartitions("cell_id", "_kind", "_year", "well_id")

    def partial(self, ask: Callable[[Block], Answer], schema: str) -> DataFrame:
        """What ``ask`` answers for blocks of series, as rows.

        An answer is an array per column of ``schema``; ``key`` holds places among the block's
        series and becomes their keys. What is not asked by series needs no key.
        """
        out = T.StructType.fromDDL(schema)
        steps, names = self.steps, list(self.names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gathered, reader = _Gathered(out), _Reader(names)
            for batch in batches:
                for block in reader.blocks(batch):
                    for step in steps:
                        step(block)
                        if not block.size:
                            break
                    else:
                        gathered.add(block, ask(block))
                    if gathered.size >= FLUSH_VALUES:
                        yield gathered.flush()
            if gathered.size:
                yield gathered.flush()

        return self._laid().mapInArrow(run, out)


class _Gathered:
    """Answers of some blocks, handed on as one batch."""

    def __init__(self, schema: T.StructType):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.schema = to_arrow_schema(schema)
        self._clear()

    def _clear(self) -> None:
        self.size, self.parts = 0, []

    def add(self, block: Block, answer: Answer) -> None:
        n = len(next(iter(answer.values())))
        if n:
            self.parts.append({f.name: self._column(block, f, answer[f.name]) for f in self.schema})
            self.size += max(values.size for values in answer.values())

    @staticmethod
    def _column(block: Block, field: pa.Field, values: np.ndarray) -> pa.Array:
        if field.name == "key":
            return pa.array([s.key for s in block.series], pa.string()).take(pa.array(values))
        if pa.types.is_list(field.type):
            ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel(), from_pandas=True), type=field.type)
        return pa.array(values, from_pandas=True).cast(field.type)

    def flush(self) -> pa.RecordBatch:
        columns = [pa.concat_arrays([p[f.name] for p in self.parts]) for f in self.schema]
        self._clear()
        return pa.RecordBatch.from_arrays(columns, schema=self.schema)


def _numbers(values: pa.Array) -> np.ndarray:
    return (pc.fill_null(values, float("nan")) if values.null_count else values).to_numpy(zero_copy_only=False)


class _Reader:
    """Blocks of the batches of a task; the weather of a batch's last cell goes on to serve the next one."""

    def __init__(self, names: list[str]):
        self.names, self.cell = names, Cell(None, names)

    def blocks(self, batch: pa.RecordBatch) -> Iterator[Block]:
        some, days = [], 0
        for one in self._series(batch):
            some.append(one)
            days += int(one.days[-1] - one.days[0]) + 1
            if days >= BLOCK_DAYS:
                yield Block(some)
                some, days = [], 0
        if some:
            yield Block(some)

    def _series(self, batch: pa.RecordBatch) -> Iterator[One]:
        of = lambda c: batch.column(batch.schema.get_field_index(c))
        cells, wells, kinds = of("cell_id").to_pylist(), of("well_id").to_pylist(), of("_kind").to_pylist()
        copies, depths = of("copies").to_pylist(), _numbers(of("depth")).tolist()
        days, ends = _flat(of("_d"))
        values = [_flat(of(f"_{i}")) for i in range(max(len(self.names), 1))]
        levels, of_levels = values[0]
        for i, kind in enumerate(kinds):
            if cells[i] != self.cell.key:
                self.cell = Cell(cells[i], self.names)
            here = days[ends[i] : ends[i + 1]]
            if kind == 0:
                self.cell.add(here, [v[e[i] : e[i + 1]] for v, e in values])
            elif len(here):
                for again in range(copies[i]):
                    yield One(wells[i], self.cell, again == 1, depths[i], here, levels[of_levels[i] : of_levels[i + 1]])


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists and where each list begins; NULL numbers as NaN."""
    ends = lists.offsets.to_numpy()
    return _numbers(lists.flatten()), ends - ends[0]
