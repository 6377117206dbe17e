"""Streams of transactions: causal windows with state per entity, scores, and figures by day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.modeling import batch_score
from ..operators.windows import range_folds, range_medians, window_length
from ..plans.artifact import Artifact
from ..plans.pipeline import VelocityStage
from ..roles import Roles


def period_kpis(stream: DataFrame, time: str, target: str, amount: str, period: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Rows, positives and amounts of each period, once it is over: a tumbling window closed by the watermark. Rows later than ``lateness`` are
    left out. Works on a batch too."""
    if stream.isStreaming:
        stream = stream.withWatermark(time, lateness)
    w = F.window(time, period, startTime="4 days") if period == "7 days" else F.window(time, period)  # weeks begin on Mondays
    out = stream.groupBy(w).agg(F.count(target).alias("n_total"), F.sum(F.col(target).cast("long")).alias("n_pos"), F.sum(F.when(F.col(target) == 0, F.col(amount))).alias("amount_neg"), F.sum(F.when(F.col(target) == 1, F.col(amount))).alias("amount_pos"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n_total", "n_pos", "amount_neg", "amount_pos")


def rolling(times: list[int], values: list[float], at: list[int], length: int, aggregates: tuple[str, ...] = ("sum", "mean", "max", "min")) -> dict[str, list]:
    """Aggregates of ``values`` over [t - length, t) for each t of ``at``; ``times`` and ``at`` ascend. Each value enters and leaves once."""
    from bisect import bisect_left, insort
    from collections import deque

    out: dict[str, list] = {a: [] for a in aggregates}
    low = high = n = 0
    total, top, least, ranked, ranks = 0.0, deque(), deque(), [], "median" in aggregates
    for t in at:
        while high < len(times) and times[high] < t:
            if (v := values[high]) is not None and v == v:
                total, n = total + v, n + 1
                while top and values[top[-1]] <= v:
                    top.pop()
                while least and values[least[-1]] >= v:
                    least.pop()
                top.append(high)
                least.append(high)
                if ranks:
                    insort(ranked, v)
            high += 1
        while low < high and times[low] < t - length:
            if (v := values[low]) is not None and v == v:
                total, n = total - v, n - 1
                if ranks:
                    del ranked[bisect_left(ranked, v)]
            low += 1
        for q in (top, least):
            while q and q[0] < low:
                q.popleft()
        if not n:
            total = 0.0
        now = {"sum": total, "mean": total / n if n else None, "max": values[top[0]] if top else None, "min": values[least[0]] if least else None}
        if ranks:
            now["median"] = (ranked[(n - 1) // 2] + ranked[n // 2]) / 2 if n else None
        for name in out:
            out[name].append(now[name] if n else None)
    return out


class _Velocity(StatefulProcessor):
    """The windows of the rows of one entity, answered in the batch that brings them. ``seen`` holds the times and values that later rows can reach; an entity that is
    idle for the longest window leaves the state if it ``forgets``."""

    def __init__(self, values: tuple[str, ...], windows: tuple[str, ...], aggregates: tuple[str, ...], forgets: bool):
        self.values, self.aggregates, self.forgets = values, aggregates, forgets
        self.lengths = {w: window_length(w) for w in windows}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "t long, " + ", ".join(f"v{i} double" for i in range(len(self.values))))

    def _take(self, frames) -> list[tuple[int, str]]:
        """Remember the times and values of new rows; the rows among them that are to be answered."""
        import pandas as pd

        new = pd.concat(list(frames))
        times = new["t_us"].tolist()
        self.seen.appendList([(t, *(None if v != v else v for v in vs)) for t, *vs in zip(times, *[new[f"v_{i}"].tolist() for i in range(len(self.values))])])
        return [(t, r) for t, r in zip(times, new["row"].tolist()) if r is not None]

    def _answer(self, rows: list[tuple[int, str]]):
        import pandas as pd

        seen = sorted(self.seen.get(), key=lambda r: r[0])
        times, rows = [r[0] for r in seen], sorted(rows, key=lambda r: r[0])
        out = {"__row": [r[1] for r in rows]}
        for i, v in enumerate(self.values):
            column = [r[i + 1] for r in seen]
            for w, length in self.lengths.items():
                for name, x in rolling(times, column, [r[0] for r in rows], length, self.aggregates).items():
                    out[f"{v}_{name}_{w}"] = x
        if seen:  # what no later row can reach
            wide = max(self.lengths.values())
            self.seen.put([r for r in seen if r[0] >= times[-1] - wide])
            self._wake(times[-1] + wide + 1)
        return pd.DataFrame(out)

    def _wake(self, due: int) -> None:
        """One timer, when the watermark has come to ``due``."""
        if self.forgets:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer(-(-due // 1000))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._take([initialState])
        self._wake(max(initialState["t_us"].tolist()) + max(self.lengths.values()) + 1)

    def handleInputRows(self, key, rows, timerValues):
        yield self._answer(self._take(rows))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


#: So many rows are packed at once, so many bytes of packs are one entry of a state's list, and so many rows that wait. More entries than MANY are put together when they are read.
PACKED, ENTRY, WAITING, MANY = 65_536, 262_144, 1024, 100


def _kind(values: int = 0):
    """A row in a pack: two hashes of its entity, its time, and what the windows see of it; null is NaN."""
    import numpy as np

    return np.dtype([("e", "<i8"), ("f", "<i8"), ("t", "<i8"), *[(f"v{i}", "<f8") for i in range(values)]])


def _packing(values: int, stretch: int, wide: int):
    """Rows (part, e, f, t, row, v0 ...) as packs (part, stretch, seen, own, rows): the rows that the windows of a stretch reach, and those whose own stretch it is with their
    text, one a line. A state's rows cost far more one by one than in packs."""

    def cut(part, of):
        """The order of the packs, and of each its part, its stretch and where it begins and ends."""
        import numpy as np

        order = np.lexsort((of, part))
        p, s = part[order], of[order]
        begin = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1])])) if len(p) else np.zeros(0, np.int64)
        return order, p[begin], s[begin], list(zip(begin.tolist(), [*begin[1:].tolist(), len(p)]))

    def packs(rows):
        import numpy as np
        import pyarrow as pa

        x = np.empty(rows.num_rows, _kind(values))
        for c in x.dtype.names:
            x[c] = rows[c].to_numpy()
        part, own = rows["part"].to_numpy(), x["t"] // stretch
        times = (x["t"] + wide) // stretch - own + 1
        at = np.repeat(np.arange(len(x)), times)
        order, p, s, ends = cut(part[at], own[at] + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times))
        dealt = x[at[order]]
        yield {"part": p, "stretch": s, "seen": [dealt[a:b].tobytes() for a, b in ends], "own": [None] * len(p), "rows": [None] * len(p)}
        told = np.flatnonzero(rows["row"].is_valid().to_numpy())
        order, p, s, ends = cut(part[told], own[told])
        told = told[order]
        waits, text = x[told][["e", "f", "t"]].astype(_kind()), rows["row"].take(pa.array(told)).to_pylist()
        yield {"part": p, "stretch": s, "seen": [None] * len(p), "own": [waits[a:b].tobytes() for a, b in ends], "rows": ["\n".join(text[a:b]) for a, b in ends]}

    def run(batches):
        import pyarrow as pa

        kind = pa.schema([("part", pa.int32()), ("stretch", pa.int64()), ("seen", pa.binary()), ("own", pa.binary()), ("rows", pa.string())])
        held = []

        def flush():
            for columns in packs(pa.Table.from_batches(held)):
                yield pa.RecordBatch.from_pydict(columns, kind)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= PACKED:
                yield from flush()
                held.clear()
        if held:
            yield from flush()

    return run


class _LateVelocity(StatefulProcessor):
    """The windows of the rows of one part of the entities in one stretch of time. ``seen`` holds packs of what they can reach, ``waiting`` packs of the rows that the watermark
    hasn't passed yet; rows that it has passed before they come are left out. All goes when the stretch is over."""

    def __init__(self, values: tuple[str, ...], windows: tuple[str, ...], aggregates: tuple[str, ...], stretch: int):
        self.values, self.aggregates, self.stretch = values, aggregates, stretch
        self.lengths = {w: window_length(w) for w in windows}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "pack binary")
        self.waiting = handle.getListState("waiting", "pack binary, rows string")

    def _over(self, key) -> int:
        return (int(key[-1]) + 1) * self.stretch

    def _wake(self, due: int) -> None:
        """One timer, when the watermark has come to ``due``."""
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(-(-due // 1000))

    def _seen_entries(self, x) -> list[tuple]:
        step = max(1, ENTRY // x.itemsize)
        return [(x[i : i + step].tobytes(),) for i in range(0, len(x), step)]

    def _waiting_entries(self, x, rows: list[str]) -> list[tuple]:
        return [(x[i : i + WAITING].tobytes(), "\n".join(rows[i : i + WAITING])) for i in range(0, len(x), WAITING)]

    def _take(self, key, frames, passed: int) -> None:
        """Remember the new rows of times after ``passed``, and wake up for the first that is to be answered."""
        import numpy as np

        seen, own, rows = [], [], []
        for frame in frames:
            seen += [bytes(x) for x in frame["seen"] if x is not None]
            for x, text in zip(frame["own"], frame["rows"]):
                if x is not None:
                    own.append(bytes(x))
                    rows += text.split("\n")
        x, y = np.frombuffer(b"".join(seen), _kind(len(self.values))), np.frombuffer(b"".join(own), _kind())
        x, in_time = x[x["t"] > passed], y["t"] > passed
        y, rows = y[in_time], [r for r, ok in zip(rows, in_time.tolist()) if ok]
        if len(x):
            self.seen.appendList(self._seen_entries(x))
        if len(y):
            self.waiting.appendList(self._waiting_entries(y, rows))
        if len(x) or len(y):
            self._wake(min([t * 1000 for t in self.handle.listTimers()] + y["t"].tolist(), default=self._over(key)))

    def _answer(self, due, rows: list[str]):
        import numpy as np
        import pandas as pd

        entries = [bytes(r[0]) for r in self.seen.get()]
        seen = np.frombuffer(b"".join(entries), _kind(len(self.values)))
        if len(entries) > MANY:
            self.seen.put(self._seen_entries(seen))
        e, f = (np.concatenate([seen[c], due[c]]) for c in "ef")
        order = np.lexsort((f, e))
        entity = np.empty(len(e), np.int64)
        entity[order] = np.concatenate([[0], np.cumsum((e[order][1:] != e[order][:-1]) | (f[order][1:] != f[order][:-1]))])
        times = np.unique(seen["t"])
        place = lambda entity, t: entity * (len(times) + 1) + np.searchsorted(times, t)
        places = place(entity[: len(seen)], seen["t"])
        order = np.argsort(places, kind="stable")
        bound = lambda t: np.searchsorted(places[order], place(entity[len(seen) :], t))
        out = {"__row": rows}
        for w, length in self.lengths.items():
            low, high = bound(due["t"] - length), bound(due["t"])
            for i, v in enumerate(self.values):
                for name in self.aggregates:
                    out[f"{v}_{name}_{w}"] = _of_ranges(name, seen[f"v{i}"][order], low, high)
        return pd.DataFrame({n: out[n] for n in ["__row", *[f"{v}_{a}_{w}" for v in self.values for w in self.lengths for a in self.aggregates]]})

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._take(key, [initialState], -(2**63))

    def handleInputRows(self, key, rows, timerValues):
        self._take(key, rows, timerValues.getCurrentWatermarkInMs() * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import numpy as np

        now = timerValues.getCurrentWatermarkInMs() * 1000  # every row up to here has come
        entries = list(self.waiting.get()) if self.waiting.exists() else []
        waiting, rows = np.frombuffer(b"".join(bytes(r[0]) for r in entries), _kind()), [x for r in entries for x in r[1].split("\n")]
        due = waiting["t"] <= now
        left = waiting[~due]
        if due.any():
            yield self._answer(waiting[due], [r for r, ok in zip(rows, due.tolist()) if ok])
            self.waiting.clear()
            if len(left):
                self.waiting.put(self._waiting_entries(left, [r for r, ok in zip(rows, due.tolist()) if not ok]))
        if not len(left) and now >= self._over(key):
            self.seen.clear()
        else:
            self._wake(min(left["t"].tolist(), default=self._over(key)))

    def close(self) -> None:
        pass


def _of_ranges(aggregate: str, values, low, high):
    """An aggregate of ``values[low:high]`` for each pair of bounds, null values (NaN) left out; NaN for none."""
    import numpy as np

    if aggregate == "median":
        return range_medians(values, low, high)
    known = ~np.isnan(values)
    counts = np.concatenate([[0], np.cumsum(known)])
    n = counts[high] - counts[low]
    fold, none = {"sum": (np.add, 0.0), "mean": (np.add, 0.0), "max": (np.maximum, -np.inf), "min": (np.minimum, np.inf)}[aggregate]
    x = range_folds(np.where(known, values, none), low, high, fold, none)
    return np.where(n > 0, x / np.maximum(n, 1) if aggregate == "mean" else x, np.nan)


_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def stream_velocity(stream: DataFrame, values: tuple[str, ...] = ("monto",), windows: tuple[str, ...] = ("1h", "1d"), aggregates: tuple[str, ...] = ("sum", "mean", "max", "min"), roles: Roles = Roles(), history: DataFrame | None = None, watermark: str | None = None, late: bool = False, stretch: str | None = None, parts: int = 64) -> DataFrame:
    """The rows of a stream with ``{value}_{aggregate}_{window}``: the same causal grid as ``velocity_grid``, append mode. ``history``, a table with entity, time and values, is what
    the first rows see. Rows without entity or time are left out.

    Unless ``late``, rows come in event-time order from batch to batch and are answered at once; the state of an entity is the longest window, in one place. With ``watermark``
    (such as "1 hour") rows later than that are left out, and entities idle for the longest window leave the state.

    With ``late`` rows may come in any order up to ``watermark`` late. A row waits in the state until the watermark has passed its time, when all that its windows see has come,
    and is then answered; rows later than that, by the watermark that the batches before have made, are left out, and the last rows of a stream wait for a later one. State is kept by
    ``stretch`` of time (a window's name, by default the longest of ``windows``) and by one of ``parts`` parts that entities, known by 128 bits of hash, are dealt to: a row goes to its own
    stretch, and its time and values to the following ones whose windows reach it. So a busy entity is
    dealt over as many tasks as the rows of a batch have stretches, and state goes when its stretch is over. Shorter stretches spread an entity more and copy values more
    often, once for each stretch in the longest window. More parts make smaller groups, of which fewer entities are read when one is due, and more calls; a stream keeps the number with its checkpoint."""
    if late and not watermark:
        raise ValueError("late rows need a watermark that says how late they may be")
    wide = max(window_length(w) for w in windows)
    length = (window_length(stretch) if stretch else wide) if late else None
    names = [f"{v}_{a}_{w}" for v in values for w in windows for a in aggregates]
    kind = StructType.fromDDL(", ".join(["__row string", *[f"`{n}` double" for n in names]]))

    def dealt(df: DataFrame, row):  # a processor's columns have plain names
        at, entity = F.unix_micros(F.col(roles.time).cast("timestamp")), F.col(roles.entity)
        df = df.where(entity.isNotNull() & F.col(roles.time).isNotNull())
        v = [F.col(x).cast("double") for x in values]
        if not late:
            df = df.select(F.col(roles.time).alias("event_time"), entity.alias("entity"), at.alias("t_us"), row.alias("row"), *[x.alias(f"v_{i}") for i, x in enumerate(v)], F.lit(0).cast("long").alias("stretch"))
            return df.groupBy("entity", "stretch")
        e = F.xxhash64(entity)
        df = df.select(F.pmod(e, F.lit(parts)).cast("int").alias("part"), e.alias("e"), F.xxhash64(F.lit("entity"), entity).alias("f"), at.alias("t"), row.alias("row"), *[x.alias(f"v{i}") for i, x in enumerate(v)])
        return df.mapInArrow(_packing(len(values), length, wide), "part int, stretch long, seen binary, own binary, rows string").groupBy("part", "stretch")

    rows = dealt(stream.withWatermark(roles.time, watermark) if watermark else stream, F.to_json(F.struct("*"), _TIMES))
    first = None if history is None else dealt(history, F.lit(None).cast("string"))
    processor = _LateVelocity(values, windows, aggregates, length) if late else _Velocity(values, windows, aggregates, bool(watermark))
    out = rows.transformWithStateInPandas(statefulProcessor=processor, outputStructType=kind, outputMode="Append", timeMode="EventTime" if watermark else "None", initialState=first)
    return out.withColumn("__row", F.from_json("__row", stream.schema, _TIMES)).select("__row.*", *names)


def stream_scores(stream: DataFrame, artifact: Artifact, name: str = "probability_1", watermark: str | None = None, late: bool = False, stretch: str | None = None) -> DataFrame:
    """The features and the probability of class 1 of the rows of a stream, by a loaded artefact: windows with state that begins with its history, its frozen maps, its
    classifier. What a row gets is what ``artifact.score`` gives it in a table with all rows before it; see ``stream_velocity`` for late rows."""
    grids = [s for s in artifact.preprocessor.stages if isinstance(s, VelocityStage)]
    if len({s.roles for s in grids}) > 1:
        raise ValueError("the windows of a stream must have one entity and one time")

    def windows_of(rows, stage, values, windows, aggregates):
        return stream_velocity(rows, values, windows, aggregates, stage.roles, stage.history, watermark, late, stretch)

    features = artifact.preprocessor.transform(artifact.checked(stream), windows_of)
    return batch_score(features, artifact.model, artifact.meta, name)
