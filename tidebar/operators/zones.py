"""Zigzag pivots, and the life of price zones.

A zone's machine takes closed bars. Its rules are written for a zone that is approached from below; one that is approached from above is the same zone with prices negated.

``ZoneBook`` holds the live zones of a series by the price that would wake them: an approaching or rejected one sleeps until a bar reaches its near edge, an accepted one
until a bar comes back to its far edge or closes far beyond it, a reclaimed one until a close far on the other side. What a sleeping
zone would count is not read by any rule that could apply next, so sleep changes nothing. Retired zones are dropped. So a series costs its bars, its events, and the bars during which
zones are tested, penetrated or retested, and not zones times bars.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, fields
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .carried import fold_blocks
from .clusters import specs_at_formation
from .recurrences import SPAN, in_blocks, with_recurrences
from .swings import plateau_specs


class Zigzag:
    """An extreme is confirmed when the reversal reaches the bar's threshold; of two that are confirmed by one bar the larger reversal, then the earlier extreme, comes first."""

    def __init__(self, state: str | None = None):
        self.side, self.hi, self.lo = json.loads(state) if state else (0, None, None)

    def dump(self) -> str:
        return json.dumps([self.side, self.hi, self.lo])

    def step(self, t, h: float, l: float, need: float | None) -> tuple | None:  # noqa: E741
        """(t of the extreme, price, kind) if the bar confirms one; bars without a threshold (null, NaN) are passed over."""
        if need is None or need != need:
            return None
        if self.hi is None:
            self.hi, self.lo = [t, h], [t, l]
            return None
        if self.side >= 0 and h > self.hi[1]:
            self.hi = [t, h]
        if self.side <= 0 and l < self.lo[1]:
            self.lo = [t, l]
        down, up = self.hi[1] - l, h - self.lo[1]
        falls, rises = need > 0 and self.side >= 0 and down >= need, need > 0 and self.side <= 0 and up >= need
        if falls and rises:
            falls = (down, self.lo[0]) > (up, self.hi[0])
        if falls:
            found, self.side, self.lo = (*self.hi, "high"), -1, [t, l]
            return found
        if rises:
            found, self.side, self.hi = (*self.lo, "low"), 1, [t, h]
            return found
        return None


def zigzag(t, h, l, thresholds):  # noqa: E741
    """(index, known index, price, kind) of a whole series."""
    machine, out = Zigzag(), []
    for i, need in enumerate(thresholds):
        if found := machine.step(i, float(h[i]), float(l[i]), need):
            out.append((found[0], i, found[1], found[2]))
    return out


def zigzag_pivots(bars: DataFrame, period: int = 14, multiple: float = 2.0, span: int = SPAN) -> DataFrame:
    """symbol, t, known_t, price, kind; a series runs in blocks of ``span`` seconds, and the machine's state is carried from block to block."""
    ranged = with_recurrences(bars, span, (), period).select("symbol", "t", "h", "l", F.col(f"atr{period}").alias("range"))

    def run(pdf: pd.DataFrame, state: str | None) -> tuple[pd.DataFrame, str]:
        machine, out = Zigzag(state), []
        for t, h, l, need in zip(*(pdf[k].tolist() for k in ("t", "h", "l", "range")), strict=True):  # noqa: E741
            if found := machine.step(t, h, l, None if need is None else multiple * need):
                out.append((found[0], t, found[1], found[2]))
        rows = pd.DataFrame(out, columns=["t", "known_t", "price", "kind"])
        rows.insert(0, "symbol", pdf["symbol"].iloc[0])
        return rows, machine.dump()

    return fold_blocks(in_blocks(ranged, span), run, "symbol string, t long, known_t long, price double, kind string")


class Policy(NamedTuple):
    """When closes beyond a zone are accepted: after ``closes`` of them, from ``distance`` average ranges on, on either, or on both. A wick never is."""

    closes: int = 2
    distance: float = 0.5
    mode: str = "either"
    retire: float = 4.0
    fallback: float = 0.01
    volume: float | None = None

    def accepts(self, on_side: bool, count: int, far: bool) -> bool:
        by = {"close_count": count >= self.closes, "atr_distance": far, "either": count >= self.closes or far, "both": count >= self.closes and far}
        return on_side and by[self.mode]


#: What a state says of its zone, and the strength that a test adds.
STATUS = {"retired": "retired", "reclaimed": "reclaimed", "accepted": "broken", "retesting": "broken"}
PER_TEST = {"reclaimed": 0.10, "rejected": 0.08}
WEAKENED = 0.45


@dataclass
class Zone:
    """A zone's frozen bounds and its state."""

    zone_id: str
    lower: float
    upper: float
    role: str
    base: float = 0.4
    up: bool = True
    state: str = "approaching"
    tests: int = 0
    beyond: int = 0
    origin: int = 0
    through: bool = False
    outcome: str | None = None

    @property
    def near(self) -> float:
        return self.lower if self.up else -self.upper

    @property
    def far(self) -> float:
        return self.upper if self.up else -self.lower

    @property
    def strength(self) -> float:
        if self.state in ("accepted", "retesting"):
            return max(0.0, min(1.0, self.base * WEAKENED))
        return max(0.0, min(1.0, self.base + PER_TEST.get(self.state, 0.04) * self.tests))

    def usable(self, atr_: float | None, fallback: float) -> float:
        return atr_ if atr_ is not None and atr_ > 0 else max(abs((self.lower + self.upper) / 2) * fallback, 1e-8)

    def open(self, close: float) -> None:
        self.up = self.role == "resistance" or (self.role == "mixed" and close <= (self.lower + self.upper) / 2)

    def step(self, h: float, l: float, c: float, atr_: float | None, v: float = 0.0, policy: Policy = Policy()) -> tuple[str, tuple[str, ...]] | None:  # noqa: E741
        """(state before, causes) if a closed bar changes the state."""
        high, low, close = (h, l, c) if self.up else (-l, -h, -c)
        a, near, far = self.usable(atr_, policy.fallback), self.near, self.far
        beyond, origin = close > far, close < near
        self.beyond, self.origin = self.beyond + 1 if beyond else 0, self.origin + 1 if origin else 0
        if beyond and policy.volume is not None and v > 0 and v >= policy.volume:
            self.beyond += 1
        accept = policy.accepts(beyond, self.beyond, close >= far + policy.distance * a)
        reclaim = policy.accepts(origin, self.origin, close <= near - policy.distance * a)
        touch = high >= near and low <= far
        self.through |= accept
        found = self._next(beyond, origin, touch, accept, reclaim, close - far >= policy.retire * a, near - close >= policy.retire * a)
        if found is None:
            return None
        old, (self.state, causes) = self.state, found
        self.tests += self.state == "testing"
        self.outcome = self._outcome()
        return old, causes

    def _next(self, beyond, origin, touch, accept, reclaim, far_out, far_back) -> tuple[str, tuple[str, ...]] | None:
        """The next state and why, where it is another one."""
        failed = "failed_breakout" if self.up else "failed_breakdown"
        match self.state:
            case "reclaimed":
                return ("retired", ("retired_extended_origin", "bounds_frozen")) if far_back else None
            case "accepted":
                if reclaim and self.through:
                    return "reclaimed", ("reclaim_acceptance", "failed_breakout" if self.up else "successful_reclaim")
                if origin or (touch and not beyond):
                    return "retesting", ("retest_opposite_side",)
                return ("retired", ("retired_extended_beyond", "accepted_through")) if far_out else None
            case "retesting":
                if reclaim:
                    return "reclaimed", ("reclaim_acceptance", "successful_reclaim")
                if accept or (beyond and not touch):
                    return "accepted", ("retest_held", *(("acceptance_beyond",) if accept else ()))
                return None
            case "retired":
                return None
        if accept:
            return ("retired", ("acceptance_beyond", "retired_extended_beyond")) if far_out else ("accepted", ("acceptance_beyond", "close_beyond"))
        if self.state == "penetrated":
            if origin:
                return "reclaimed", ("failed_hold", failed, "close_origin", "had_close_beyond")
            return ("testing", ("pullback_into_zone", "close_in_zone")) if touch and not beyond else None
        if beyond:
            return "penetrated", ("close_beyond",)
        if self.state == "testing":
            return ("rejected", ("rejected_close_origin",)) if origin else None
        return ("testing", ("probe",) if origin else ("close_in_zone",)) if touch else None

    def _outcome(self) -> str | None:
        match self.state:
            case "reclaimed":
                return "failed_breakout" if self.up else "successful_reclaim" if self.through else "failed_breakdown"
            case "accepted" | "retesting":
                return "accepted_through"
            case "retired":
                return self.outcome or ("accepted_through" if self.through else None)
            case "rejected":
                return "held"
        return None


class Event(NamedTuple):
    zone_id: str
    t: int
    before: str
    state: str
    causes: str
    tests: int
    strength: float
    outcome: str | None
    status: str
    close: float


class ZoneBook:
    """The live zones of one series. ``declare`` takes a zone that opens with the first bar from ``known_t`` on, ``step`` a closed bar."""

    WAKES = {"near": ("approaching", "rejected"), "back": ("accepted",), "out": ("accepted",), "gone": ("reclaimed",)}

    def __init__(self, policy: Policy = Policy()):
        self.policy = policy
        self.pending: list[tuple[int, str]] = []
        self.zones: dict[str, Zone] = {}
        self.awake: set[str] = set()
        # by side: near edges of approaching and rejected zones, far edges of accepted ones from above and from below, near edges of reclaimed ones
        self.sleeping = {up: {k: [] for k in self.WAKES} for up in (True, False)}
        # in which of these a zone is laid, so that it is in none of them twice
        self.laid: dict[str, set[str]] = {}
        #: zones that a caller has to write down again
        self.changed: set[str] = set()

    def declare(self, known_t: int, zone: Zone) -> None:
        self.zones[zone.zone_id] = zone
        heapq.heappush(self.pending, (known_t, zone.zone_id))
        self.changed.add(zone.zone_id)

    def restore(self, zone: Zone) -> None:
        """Puts back a zone that is open."""
        self.zones[zone.zone_id] = zone
        self._lay(zone)

    def _lay(self, zone: Zone) -> None:
        if zone.state == "retired":
            del self.zones[zone.zone_id]
            self.laid.pop(zone.zone_id, None)
            return
        asleep = False
        for name, states in self.WAKES.items():
            if zone.state in states:
                asleep, laid = True, self.laid.setdefault(zone.zone_id, set())
                if name not in laid:
                    laid.add(name)
                    edge = {"near": zone.near, "back": -zone.far, "out": zone.far, "gone": -zone.near}[name]
                    heapq.heappush(self.sleeping[zone.up][name], (edge, zone.zone_id))
        if not asleep:
            self.awake.add(zone.zone_id)

    def _due(self, h: float, l: float, c: float, atr_: float | None) -> set[str]:  # noqa: E741
        due, self.awake = self.awake, set()
        usable = atr_ is not None and atr_ > 0
        for up, at in self.sleeping.items():
            high, low, close = (h, l, c) if up else (-l, -h, -c)
            # without an average range the distance depends on each zone's own middle
            least = self.policy.retire * atr_ if usable else 0.0
            woken = {"near": lambda x: high >= x, "back": lambda x: low <= -x, "out": lambda x: close - x >= least, "gone": lambda x: -x - close >= least}
            for name, heap in at.items():
                while heap and woken[name](heap[0][0]):
                    zone_id = heapq.heappop(heap)[1]
                    self.laid.get(zone_id, set()).discard(name)
                    # what a zone left behind in an earlier state is void
                    if zone_id in self.zones and self.zones[zone_id].state in self.WAKES[name]:
                        due.add(zone_id)
        return due

    def step(self, t: int, h: float, l: float, c: float, atr_: float | None = None, v: float = 0.0) -> list[Event]:  # noqa: E741
        due, out = self._due(h, l, c, atr_), []
        while self.pending and self.pending[0][0] <= t:
            zone = self.zones[heapq.heappop(self.pending)[1]]
            zone.open(c)
            out.append(Event(zone.zone_id, t, "none", "approaching", "opened,range_declared", 0, zone.strength, None, "active", c))
            due.add(zone.zone_id)
        for zone_id in sorted(due):
            zone = self.zones[zone_id]
            if change := zone.step(h, l, c, atr_, v, self.policy):
                out.append(Event(zone_id, t, change[0], zone.state, ",".join(change[1]), zone.tests, zone.strength, zone.outcome, STATUS.get(zone.state, "active"), c))
            self._lay(zone)
        self.changed |= due
        return out


def dump_zone(zone: Zone, known_t: int | None) -> str:
    return json.dumps([known_t, *asdict(zone).values()])


def load_zone(text: str) -> tuple[int | None, Zone]:
    known_t, *values = json.loads(text)
    return known_t, Zone(**dict(zip((f.name for f in fields(Zone)), values, strict=True)))


#: Zones of a series that one task sweeps; more are dealt out by their id, each part with the series' bars.
ZONES = 200_000


def zone_events(bars: DataFrame, zones: DataFrame, policy: Policy = Policy(), parts: int | None = None) -> DataFrame:
    """Events of zones (symbol, zone_id, lower, upper, role, known_t, and strength if there is one) over the bars from known_t on:
    symbol, zone_id, t, from_state, state, causes, tests, strength, outcome, status, close.

    A series is one sorted pass that holds its live zones and one batch of rows. ``parts`` tasks share a symbol's zones; without it, so many as
    its zones ask for.
    """
    ranged = with_recurrences(bars, spans=()).select("symbol", "t", "h", "l", "c", "v", "atr14")
    declared = zones.select("symbol", F.col("known_t").alias("t"), "zone_id", "lower", "upper", "role", (F.col("strength") if "strength" in zones.columns else F.lit(0.4)).alias("base"))
    if parts is None:
        most = declared.groupBy("symbol").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
        parts = max(1, -(-most // ZONES))
    declared = declared.withColumn("part", F.pmod(F.xxhash64("zone_id"), F.lit(parts)))
    ranged = ranged.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>")))
    # a zone known at t opens with the bar of t: it comes first
    rows = declared.unionByName(ranged, allowMissingColumns=True).withColumn("bar", F.col("zone_id").isNull())
    rows = rows.repartition("symbol", "part").sortWithinPartitions("symbol", "part", "t", "bar")

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = book = None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if (r.symbol, r.part) != key:
                    key, book = (r.symbol, r.part), ZoneBook(policy)
                if r.bar:
                    out += [(r.symbol, *e) for e in book.step(int(r.t), r.h, r.l, r.c, None if pd.isna(r.atr14) else r.atr14, r.v)]
                else:
                    book.declare(int(r.t), Zone(r.zone_id, r.lower, r.upper, r.role, r.base))
            yield pd.DataFrame(out, columns=["symbol", "zone_id", "t", "from_state", "state", "causes", "tests", "strength", "outcome", "status", "close"])

    return rows.mapInPandas(sweep, "symbol string, zone_id string, t long, from_state string, state string, causes string, tests int, strength double, outcome string, status string, close double")


def tracked_zones(bars: DataFrame, pivots: DataFrame, minutes: int, policy: Policy = Policy()) -> DataFrame:
    """The zones of a series as they stand after its last bar: those of its pivots (symbol, t, known_t, price, kind), with the role of their formation, and its plateaus.

    symbol, zone_id, lower, upper, role, strength, tests, source, status, state, created_t, known_t, last_test_t, outcome. A zone that no bar has reached since it was known is not there.
    """
    specs = specs_at_formation(pivots, bars).select("symbol", "zone_id", "lower", "upper", "role", "strength", "created_t", "known_t")
    flat = plateau_specs(bars, minutes).join(specs.select("symbol", "zone_id"), ["symbol", "zone_id"], "left_anti").select(specs.columns)
    specs = specs.unionByName(flat)
    events = zone_events(bars, specs, policy).groupBy("symbol", "zone_id")
    # opening and first change can share a time; the opening comes first
    last = F.max_by(F.struct("state", "strength", "tests", "outcome", "status"), F.struct("t", F.col("from_state") != "none"))
    now = events.agg(last.alias("now"), F.max(F.when(F.col("state") == "testing", F.col("t"))).alias("last_test_t"))
    rows = now.join(specs.drop("strength"), ["symbol", "zone_id"])
    return rows.select("symbol", "zone_id", "lower", "upper", "role", "now.strength", "now.tests", F.lit("zone_lifecycle").alias("source"), "now.status", "now.state", "created_t", "known_t", "last_test_t", "now.outcome")
