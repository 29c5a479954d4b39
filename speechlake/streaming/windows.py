"""Windows over streams: a fixed number of samples per stream, and event time."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

COUNT_SCHEMA = "stream bigint, window_index bigint, start bigint, n int, mean double, peak double, is_final boolean"


class CountWindows(StatefulProcessor):
    """Emits each complete window of `size` samples every `hop`, whatever the batches that the samples come in.

    State per stream: the samples that a later window still needs (fewer than size + hop), their start and
    the next window's number. Rows are ordered by idx within a batch. A control row (`control`: "flush",
    "reset" or "drop") acts after the samples before it: flush emits what remains, padded with zeros, as
    the final window; reset forgets the stream; drop forgets the samples but goes on numbering.
    """

    def __init__(self, size: int, hop: int):
        self.size, self.hop = size, hop

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.samples = handle.getListState("samples", "x double")
        self.place = handle.getValueState("place", "start bigint, number bigint")

    def _windows(self, key: int, x: list[float], start: int, number: int) -> tuple[list[tuple], list[float], int, int]:
        out = []
        while len(x) >= self.size:
            w = x[: self.size]
            out.append((key, number, start, self.size, sum(w) / self.size, max(map(abs, w)), False))
            x, start, number = x[self.hop :], start + self.hop, number + 1
        return out, x, start, number

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("idx")
        start, number = self.place.get() if self.place.exists() else (0, 0)
        x = [r[0] for r in self.samples.get()] if self.samples.exists() else []
        out = []
        for value, control in zip(frame["x"], frame["control"], strict=True):
            if control is None or control != control:
                x.append(float(value))
                if len(x) >= self.size:
                    made, x, start, number = self._windows(key[0], x, start, number)
                    out += made
            elif control == "flush" and x:
                w = x[: self.size]
                out.append((key[0], number, start, len(w), sum(w) / self.size, max(map(abs, w)), True))
                x, start, number = [], start + len(w), number + 1
            elif control == "reset":
                x, start, number = [], 0, 0
            elif control == "drop":
                x, start = [], start + len(x)
        self.place.update((int(start), int(number)))
        if x:
            self.samples.put([(v,) for v in x])
        elif self.samples.exists():
            self.samples.clear()
        columns = [c.split()[0] for c in COUNT_SCHEMA.split(", ")]
        yield pd.DataFrame(out, columns=columns).astype({"stream": "int64", "window_index": "int64", "start": "int64", "n": "int32", "mean": "float64", "peak": "float64", "is_final": "bool"})

    def close(self) -> None:
        pass


def count_windows(samples: DataFrame, stream: str, size: int, hop: int) -> DataFrame:
    """Windows of a stream of (stream, idx, x, control). The state store must be RocksDB."""
    return samples.groupBy(stream).transformWithStateInPandas(CountWindows(size, hop), COUNT_SCHEMA, "Append", "None")


def with_gain(samples: DataFrame, value: str, gain_db: float) -> DataFrame:
    """A fixed gain in place of whole-signal normalisation, which a stream cannot have."""
    return samples.withColumn(value, F.col(value) * float(10 ** (gain_db / 20)))


def count_windows_batch(samples: DataFrame, stream: str, idx: str, value: str, size: int, hop: int, gain_db: float = 0.0) -> DataFrame:
    """The same windows from a table: (stream, window_index, start, n, mean, peak, is_final), with the padded final one."""
    rows = with_gain(samples, value, gain_db)
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col(idx) - size + 1) / hop).cast("long"))
    spread = rows.withColumn("window_index", F.explode(F.sequence(first, F.floor(F.col(idx) / hop).cast("long"))))
    total = rows.groupBy(stream).agg(F.count(F.lit(1)).alias("_n"))
    out = spread.groupBy(stream, "window_index").agg(F.count(F.lit(1)).cast("int").alias("n"), (F.sum(value) / size).alias("mean"), F.max(F.abs(value)).alias("peak")).join(total, stream)
    full = F.greatest(F.floor((F.col("_n") - size) / hop) + 1, F.lit(0))
    left = F.col("_n") - full * hop
    kept = (F.col("n") == size) | ((F.col("window_index") == full) & (left > 0))
    return out.where(kept & (F.col("window_index") <= full)).select(stream, "window_index", (F.col("window_index") * hop).alias("start"), "n", "mean", "peak", (F.col("window_index") == full).alias("is_final"))


def time_windows(rows: DataFrame, ts: str, keys: list[str], size: str, hop: str, value: str, late: str | None = None) -> DataFrame:
    """(keys, start, n, mean) per event-time window; rows later than `late` are dropped by the watermark."""
    if late:
        rows = rows.withWatermark(ts, late)
    return rows.groupBy(*keys, F.window(ts, size, hop).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(*keys, F.col("w.start").alias("start"), "n", "mean")
