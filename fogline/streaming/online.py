"""The grid filter on a stream: a belief is keyed state, carried from batch to batch and dropped when its round is over.

A key is an entity's round. Its state holds the belief after the last row, when the entity was last sighted and the time
of the last row; a timer of event time clears it when the watermark passes the round's end. Rows of one batch are put in
order of time before they are taken; a row that is not after the last one taken is answered with late and changes
nothing. What is put out equals the batch recursion over the same rows. Steps that a task has taken once are looked up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import belief as b

ROWS = "us long, event_id long, seen int, true int, until long"
OUT = "event_id long, step int, since double, p_region double, region_rank int, late boolean"
STATE = "belief binary, us long, event_id long, step int, since double, seen_t double"
PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Belief:
    """A belief, what is said of each region, and the beliefs that one more step has led to from here."""

    def __init__(self, mass: np.ndarray, region: np.ndarray):
        self.mass = mass
        regions = np.bincount(region, mass)
        self.said = [(float(own), int((regions >= own * b.TIED).sum()) - 1) for own in regions]
        self.then: dict[tuple, Belief] = {}


class Steps:
    """The recursion of b.run_cells() for one entity without kills and fires, step by step. A sighting makes a belief that
    is the same whatever it was before; from there on entities that are moved and looked for alike share their beliefs, so
    a step that was taken once in a task is looked up."""

    #: Beliefs that a task keeps at most; when there are more, it starts anew.
    MOST = 20_000

    def __init__(self, models: b.Models, cfg: b.Recursion, unseen: Callable[[np.ndarray], np.ndarray] | None, side: int = 0, phase: int = 0):
        self.models, self.cfg, self.unseen, self.side, self.phase = models, cfg, unseen, side, phase
        self.seen: dict[int, Belief] = {}
        self.looks: dict[int, np.ndarray | None] = {}
        self.start, self.kept = Belief(models.spawn[side], models.region), 0

    def take(self, past: Belief, t: float, age: float | None, seen: int) -> Belief:
        """The belief after a step. age: since the last sighting as of the step before, nan: never, None: there was none."""
        if seen >= 0 and seen in self.seen:
            return self.seen[seen]
        if self.cfg.motion == "prior":
            bins = self.models.occupancy[self.side, self.phase]
            move = min(int(t // self.models.time_bin), len(bins) - 1)
        else:
            move = -1 if age is None or self.cfg.motion == "none" else b.since_bin(age)
        known = past.then.get((move, seen))
        if known is None:
            if self.kept >= self.MOST:
                self.seen, self.start, self.kept = {}, Belief(self.models.spawn[self.side], self.models.region), 0
                past = Belief(past.mass, self.models.region)
            known = past.then[move, seen] = Belief(self._after(past.mass, move, seen), self.models.region)
            self.kept += 1
            if seen >= 0:
                self.seen[seen] = known
        return known

    def _after(self, mass: np.ndarray, move: int, seen: int) -> np.ndarray:
        cfg, models = self.cfg, self.models
        if cfg.motion == "prior":
            mass = models.occupancy[self.side, self.phase][move]
        elif move >= 0:
            learned = models.chains.get((self.side, self.phase, move, -1)) if cfg.motion == "learned" else None
            mass = (learned or models.walk).moved(mass)
        if seen not in self.looks:
            self.looks[seen] = None if self.unseen is None else self.unseen(np.array([seen])) ** cfg.gamma
        if cfg.unseen and self.looks[seen] is not None:
            mass = b._normal(mass * self.looks[seen], mass)
        if seen >= 0:
            mass = (np.arange(models.n) == seen).astype(float)
        return mass if cfg.motion == "prior" else (1 - b.FLOOR) * mass + b.FLOOR / models.n


class OnlineFilter(StatefulProcessor):
    """One grid recursion a key. second: the rows' units of time in a second of the models."""

    def __init__(self, names: Sequence[str], models: b.Models, cfg: b.Recursion, unseen: Callable[[np.ndarray], np.ndarray] | None, second: float):
        self.row, self.models, self.cfg, self.unseen, self.second = Row(*names), models, cfg, unseen, second

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("belief", STATE)
        self.steps, self.region = Steps(self.models, self.cfg, self.unseen), self.models.region.tolist()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        batch = sorted(((r.us, r.event_id, r.seen, r.true, r.until) for r in rows), key=lambda r: r[:2])  # a round's rows
        held = self.held.get()
        belief, at, step, age, seen_t = self.steps.start, (-(1 << 62), -1), -1, None, -np.inf
        if held is not None:
            blob, us, event, step, since, seen_t = held
            belief, at, age = Belief(np.frombuffer(blob, float), self.models.region), (us, event), np.nan if since < 0 else since
        first = step
        for us, event, seen, true, _ in batch:
            # a repeated row comes in the same batch or a later one: either way it is not after itself
            if (us, event) <= at:
                yield self.row(*key, event, -1, None, None, -1, True)
                continue
            t, at, step = us / self.second, (us, event), step + 1
            belief = self.steps.take(belief, t, age, seen)
            seen_t = t if seen >= 0 else seen_t
            age = t - seen_t if seen_t > -np.inf else np.nan
            yield self.row(*key, event, step, None if np.isnan(age) else age, *belief.said[self.region[true]], False)
        if step > first:
            self.held.update((belief.mass.tobytes(), *at, step, -1.0 if np.isnan(age) else age, seen_t))
            if held is None:
                self.handle.registerTimer(max(r[4] for r in batch) // 1000)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def beliefs(rows: DataFrame, keys: Sequence[str], models: b.Models, cfg: b.Recursion, unseen=None, second: float = 1e6) -> DataFrame:
    """(keys, OUT): how likely each row's true region was. rows: a stream with a watermark; keys (long or string), ROWS
    (until: when the key's round ends). The session must have the state store of PROVIDER."""
    schema = ", ".join([f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys] + [OUT])
    names = [*keys, *(x.split()[0] for x in OUT.split(", "))]
    return rows.groupBy(*keys).transformWithState(OnlineFilter(names, models, cfg, unseen, second), schema, "append", "eventTime")
