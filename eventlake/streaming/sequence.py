"""Temporal correlations over streams: a state machine for each group, on event time.

A group's state is small: the latest start of a chain that has reached each rule (unordered: the last time
of each rule), and the hits that the watermark has not passed yet. A timer at the earliest of those
makes the group catch up in order of time, so hits that come late, but within the delay, count as if
they had come in time. A group that is silent for a timespan is forgotten.

The state lies in RocksDB (see the session settings); a group's waiting hits are those of one delay.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from eventlake.operators.correlate import Correlation
from eventlake.session import ship_package


class Chain:
    """Progress of one group: `reached[i]` is the latest start of a chain of the rules 0 to i (unordered: the last hit of rule i)."""

    def __init__(self, positions: list[list[int]], size: int, span: int, ordered: bool) -> None:
        self.positions, self.size, self.span, self.ordered = positions, size, span, ordered

    def at(self, reached: list[int | None], us: int, seen: set[int]) -> bool:
        """Take all rules hit at an instant; whether the correlation is met then."""
        if not self.ordered:
            for rule in seen:
                for i in self.positions[rule]:
                    reached[i] = us
            return all(r is not None and r >= us - self.span for r in reached)
        hit = {i for rule in seen for i in self.positions[rule]}
        for i in sorted(hit):
            start = us if i == 0 else reached[i - 1]
            if start is not None and (reached[i] is None or start > reached[i]):
                reached[i] = start
        last = reached[-1]
        return self.size - 1 in hit and last is not None and last >= us - self.span


class ChainProcessor(StatefulProcessor):
    """Keeps a `Chain` for each key; see the module's text."""

    def __init__(self, rules: tuple[str, ...], span_seconds: int, ordered: bool) -> None:
        self.rules = list(dict.fromkeys(rules))
        positions = [[i for i, r in enumerate(rules) if r == rule] for rule in self.rules]
        self.chain = Chain(positions, len(rules), span_seconds * 1_000_000, ordered)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "reached array<bigint>, last bigint")
        self.waiting = handle.getListState("waiting", "us bigint, rule int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        number = {rule: i for i, rule in enumerate(self.rules)}
        new = {(row["__us"], number[row["rule_id"]]) for row in rows if row["rule_id"] in number}
        if new:
            self.waiting.appendList(sorted(new))
            self.handle.registerTimer(min(new)[0] // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        hits = sorted(set(self.waiting.get()))
        ready = [h for h in hits if h[0] <= passed]
        reached, last = [None] * self.chain.size, None
        if self.progress.exists():
            reached, last = self.progress.get()
            reached = list(reached)
        met, at = [], 0
        while at < len(ready):
            us, seen = ready[at][0], set()
            while at < len(ready) and ready[at][0] == us:
                seen.add(ready[at][1])
                at += 1
            if self.chain.at(reached, us, seen):
                met.append(us)
            last = us
        rest = hits[len(ready) :]
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
        if rest:
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        if last is not None and last + self.chain.span < passed and not rest:
            self.progress.clear()
        elif last is not None:
            self.progress.update((reached, last))
            if not rest:
                self.handle.registerTimer((last + self.chain.span) // 1000 + 2)
        for us in met:
            yield Row(**{f"__k{i}": value for i, value in enumerate(key)}, __us=us, n=self.chain.size)

    def close(self) -> None:
        pass


def stream_sequences(hits: DataFrame, spec: Correlation, delay: str, time: str = "time") -> DataFrame:
    """Times at which a group of a stream of hits meets a temporal correlation: group columns, time, n.

    The same rows as `correlate` gives on the same hits, each once the watermark has passed it. Hits
    later than `delay` are lost, as the watermark says.
    """
    if spec.kind not in ("temporal", "temporal_ordered"):
        raise ValueError(f"{spec.kind} is no sequence")
    ship_package(hits.sparkSession)
    marked = hits.withWatermark(time, delay).select(
        *[F.col(g).alias(f"__k{i}") for i, g in enumerate(spec.group_by)],
        F.col(time).alias("__time"),
        "rule_id",
        F.unix_micros(F.col(time).cast("timestamp")).alias("__us"),
    )
    keys = [f"__k{i}" for i in range(len(spec.group_by))]
    fields = [T.StructField(k, marked.schema[k].dataType) for k in keys]
    output = T.StructType([*fields, T.StructField("__us", T.LongType()), T.StructField("n", T.LongType())])
    met = marked.groupBy(*keys).transformWithState(
        statefulProcessor=ChainProcessor(spec.rules, spec.span_seconds, spec.kind == "temporal_ordered"),
        outputStructType=output,
        outputMode="Append",
        timeMode="EventTime",
    )
    return met.select(*[F.col(k).alias(g) for k, g in zip(keys, spec.group_by)], F.timestamp_micros("__us").alias(time), "n")
