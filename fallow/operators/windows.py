"""Change, lag and centred rolling statistics along a time series per entity.

All of them are positional: the neighbour of a row is the next row of the same
entity, whatever its year.  Every column built from one ``PanelWindow`` shares
one window specification, so Spark plans one exchange and one sort for all; a
window function that several columns need (the mean of a frame, its row count)
is evaluated once.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fallow.functions.frames import FrameFunction
from fallow.session import ship_package

CHUNK = "__chunk"
HALO = "__halo"
BLOCK = 10_000


class Rolling(NamedTuple):
    """Any function over the rolling frames of a column; see ``fallow.functions.frames``."""

    column: str
    function: FrameFunction
    width: int
    align: str = "center"

    @property
    def ends(self) -> tuple[int, int]:
        """Rows behind and ahead of a row that its frame takes in."""
        back = {"left": 0, "center": (self.width - 1) // 2, "right": self.width - 1}[self.align]
        return back, self.width - 1 - back


class PanelWindow:
    """Window over ``keys`` ordered by ``time``.

    In a panel with one row per entity and year a window group holds at most
    one row per year, whatever the table size, and ``chunk`` stays unset.

    For long series, where one entity may hold a large part of the table,
    ``chunk`` is an expression that never decreases with ``time`` (an hour
    number, ``floor(Yr / 1000)``).  Rows are numbered along their series with
    its help and dealt out in blocks of ``BLOCK`` rows; each block also receives
    the rows of its neighbours that its frames reach, so that no task has to
    hold a whole entity and the results do not change.
    """

    def __init__(
        self,
        keys: Sequence[str],
        time: Sequence[str] | str,
        chunk: Column | None = None,
    ):
        self.keys = list(keys)
        self.time = [time] if isinstance(time, str) else list(time)
        self.chunk = chunk
        self.parts: dict[str, Column] = {}
        self.reach = 1  # rows to either side that a column looks at
        groups = self.keys + ([CHUNK] if chunk is not None else [])
        self.spec = Window.partitionBy(*groups).orderBy(*self.time)

    def change(self, c: str) -> Column:
        """Next row's value minus this row's value."""
        return self._part(f"lead {c}", F.lead(c, 1).over(self.spec)) - F.col(c)

    def lag(self, c: str) -> Column:
        return self._part(f"lag {c}", F.lag(c, 1).over(self.spec))

    def frame(self, width: int, align: str = "center"):
        """Row frame of a rolling window; an even centred one leans forward."""
        back = {"left": 0, "center": (width - 1) // 2, "right": width - 1}[align]
        ahead = width - 1 - back
        self.reach = max(self.reach, back, ahead)
        return self.spec.rowsBetween(-back, ahead)

    def roll(self, c: str, agg, width: int, align: str = "center") -> Column:
        """Any aggregate over a full rolling frame.

        Frames cut off by the end of the series give NULL.  Missing values
        inside a full frame are skipped, so the frame is counted in rows.
        """
        f = self.frame(width, align)
        rows = self._part(f"rows {width} {align}", F.count(F.lit(1)).over(f))
        value = self._part(f"{agg.__name__} {id(agg)} {width} {align} {c}", agg(F.col(c)).over(f))
        return F.when(rows == width, value)

    def rolling_mean(self, c: str, width: int) -> Column:
        return self.roll(c, F.avg, width)

    def rolling_sd(self, c: str, width: int) -> Column:
        return self.roll(c, F.stddev_samp, width)

    def rolling_cv(self, c: str, width: int = 3) -> Column:
        """Coefficient of variation: sd / mean of the frame."""
        return F.try_divide(self.rolling_sd(c, width), self.rolling_mean(c, width))

    def _part(self, name: str, window_function: Column) -> Column:
        """A window function that several columns may use; it is evaluated once."""
        self.parts[f"__{name}"] = window_function
        return F.col(f"`__{name}`")

    def _evaluate(self, df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
        return df.withColumns(self.parts).withColumns(dict(columns)).drop(*self.parts)

    def with_columns(self, df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
        """Add columns built from this window's methods to ``df``."""
        if self.chunk is None:
            return self._evaluate(df, columns)
        return self._evaluate(self._blocks(df), columns).where(~F.col(HALO)).drop(CHUNK, HALO)

    def with_rolling(self, df: DataFrame, columns: Mapping[str, Rolling]) -> DataFrame:
        """Add columns of functions that are no built-in aggregate, over full rolling frames.

        Frames cut off by the end of the series give NULL, and so does a NaN of the function.  Rows are
        shuffled once by series (or block of a long series, with its border rows), sorted, and streamed
        through Python in Arrow batches: a function sees all frames of a batch as one matrix, whatever
        number of series they come from, and a task holds one batch and the rows its frames reach.
        """
        self.reach = max([self.reach, *(max(r.ends) for r in columns.values())])
        groups = list(self.keys)
        rows = df
        if self.chunk is not None:
            rows, groups = self._blocks(df), [*self.keys, CHUNK]
        ship_package(df.sparkSession)
        sources = {f"__of_{name}": F.col(r.column).cast("double") for name, r in columns.items()}
        ordered = rows.withColumns(sources).repartition(*groups).sortWithinPartitions(*groups, *self.time)
        schema = T.StructType([*ordered.drop(*sources).schema.fields, *(T.StructField(name, T.DoubleType()) for name in columns)])
        out = ordered.mapInArrow(_roll_batches(groups, dict(columns)), schema)
        return out if self.chunk is None else out.where(~F.col(HALO)).drop(CHUNK, HALO)

    def _blocks(self, df: DataFrame) -> DataFrame:
        """Rows by block of their series, and copies of border rows for the blocks beside."""
        size = max(BLOCK, self.reach)
        rows = df.withColumn(CHUNK, self.chunk)
        inside = Window.partitionBy(*self.keys, CHUNK).orderBy(*self.time)
        series = Window.partitionBy(*self.keys).orderBy(CHUNK)
        # one row per chunk; the series' own window is over these
        counts = rows.groupBy(*self.keys, CHUNK).agg(F.count(F.lit(1)).alias("__n"))
        starts = counts.withColumn("__start", F.sum("__n").over(series) - F.col("__n")).drop("__n")
        names = {c: f"__{c}_of_start" for c in [*self.keys, CHUNK]}
        starts = starts.withColumnsRenamed(names)
        same = None
        for c, other in names.items():
            term = F.col(c).eqNullSafe(F.col(other))
            same = term if same is None else same & term
        numbered = rows.withColumn("__no", F.row_number().over(inside)).join(starts, same)
        place = F.col("__start") + F.col("__no") - 1
        block, at = F.floor(place / size), place % size
        before = F.when(at < self.reach, F.struct((block - 1).alias("to"), F.lit(True).alias("halo")))
        after = F.when(at >= size - self.reach, F.struct((block + 1).alias("to"), F.lit(True).alias("halo")))
        sent = F.array_compact(F.array(F.struct(block.alias("to"), F.lit(False).alias("halo")), before, after))
        return numbered.select(*df.columns, F.explode(sent).alias("__sent")).select(
            *df.columns, F.col("__sent.to").alias(CHUNK), F.col("__sent.halo").alias(HALO)
        )


def _starts(table: pa.Table, groups: Sequence[str]) -> np.ndarray:
    """Number of the series of each row; equal neighbours in all ``groups`` are one series."""
    new = np.zeros(table.num_rows, bool)
    for g in groups:
        codes = pc.dictionary_encode(table[g].combine_chunks(), null_encoding="encode")
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        at = codes.indices.to_numpy(zero_copy_only=False)
        new[1:] |= at[1:] != at[:-1]
    return np.cumsum(new)


def _roll_batches(groups: Sequence[str], columns: Mapping[str, Rolling]):
    """Stream sorted rows; the last rows of a batch wait for those that their frames reach."""
    back = max(r.ends[0] for r in columns.values())
    ahead = max(r.ends[1] for r in columns.values())

    def rolled(table: pa.Table, series: np.ndarray, rolling: Rolling, name: str) -> np.ndarray:
        x = table[f"__of_{name}"].to_numpy().astype(float)  # missing values are NaN
        out = np.full(len(x), np.nan)
        if len(x) >= rolling.width:
            whole = series[: len(x) - rolling.width + 1] == series[rolling.width - 1 :]
            first = np.flatnonzero(whole)
            frames = np.lib.stride_tricks.sliding_window_view(x, rolling.width)[first]
            if len(first):
                out[first + rolling.ends[0]] = rolling.function(frames)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, 0  # waiting rows, of which the first `done` were given out and are kept as context

        def give(table: pa.Table, upto: int) -> Iterator[pa.RecordBatch]:
            series = _starts(table, groups)
            out = table.drop_columns([f"__of_{name}" for name in columns])
            for name, rolling in columns.items():
                out = out.append_column(name, pa.array(rolled(table, series, rolling, name), from_pandas=True))
            yield from out.slice(done, upto - done).combine_chunks().to_batches()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            upto = held.num_rows - ahead
            if upto > done:
                yield from give(held, upto)
                keep = max(0, upto - back)
                held, done = held.slice(keep), upto - keep
        if held is not None and held.num_rows > done:
            yield from give(held, held.num_rows)

    return run
