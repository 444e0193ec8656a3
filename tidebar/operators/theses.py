"""A ledger of competing theses whose invalidation never moves, and its rebuild from bars.

A thesis version is sealed when it is opened: its rules, and the SHA-256 of their canonical JSON. It is closed by a rule that fires on a bar of the rule's own timeframe, or by hand, or by a successor with
other rules; a wish to move a rule is written down and refused. The ledger is an ordered fold over commands and gives its events, and the state of a version after each change; both only ever grow.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .carried import sorted_pass
from .regimes import confirmed_pivots

#: Regimes of a relief, the bars in which it is looked for and over which its structure is measured, and what a thesis needs.
RELIEF, TAIL, RELIEF_STRUCTURE, LEAST_BARS, GAP = ("bullish", "transition_up"), 48, 24, 7, 1.002


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def rule(rule_id: str, kind: str, price: float, timeframe: str, description: str = "") -> dict:
    if kind not in _FIRES:
        raise ValueError(f"no such kind of rule: {kind}")
    if price != price:
        raise ValueError("a rule needs a price")
    return {"id": rule_id, "kind": kind, "price": float(price), "timeframe": timeframe, "description": description}


#: On (price, high, low, close).
_FIRES = {
    "close_above": lambda p, h, l, c: c > p,
    "close_below": lambda p, h, l, c: c < p,
    "high_above": lambda p, h, l, c: h > p,
    "low_below": lambda p, h, l, c: l < p,
}


def fires(r: dict, timeframe: str, h: float, l: float, c: float) -> bool:  # noqa: E741
    """A bar of another timeframe fires nothing."""
    return r["timeframe"] == timeframe and _FIRES[r["kind"]](r["price"], h, l, c)


def fingerprint(rules: list[dict]) -> str:
    """Of the rules' own fingerprints, in order."""
    return sha256(canonical([sha256(canonical(r)) for r in rules]))


@dataclass
class Thesis:
    thesis_id: str
    lineage_id: str
    version: int
    direction: str
    kind: str
    created_at: int
    confirmation: list[dict]
    invalidation: list[dict]
    evidence: list[str] = field(default_factory=list)
    counter: list[str] = field(default_factory=list)
    status: str = "active"
    closed_at: int | None = None
    reason: str | None = None
    fired: list[str] = field(default_factory=list)
    supersedes: str | None = None
    superseded_by: str | None = None

    @property
    def seal(self) -> str:
        return fingerprint(self.invalidation)


#: What ledger() and rebuilt_theses() give; event rows have what, at, thesis_id, action and detail alone.
SCHEMA = """symbol string, what string, at long, thesis_id string, action string, detail string, lineage_id string, version int, direction string, kind string, status string, created_at long, closed_at long,
    closure_reason string, fired string, supersedes string, superseded_by string, evidence string, counter_evidence string, confirmation_rules string, invalidation_rules string, invalidation_fingerprint string"""


class Ledger:
    """Theses of one symbol. Every method gives the rows that it adds."""

    def __init__(self, symbol: str):
        self.symbol, self.theses, self.seals = symbol, {}, {}

    def _event(self, at: int, thesis_id: str, action: str, detail: str) -> tuple:
        return (self.symbol, "event", at, thesis_id, action, detail, *[None] * 16)

    def _version(self, at: int, t: Thesis) -> tuple:
        listed = map(canonical, (t.evidence, t.counter, t.confirmation, t.invalidation))
        return (self.symbol, "version", at, t.thesis_id, None, None, t.lineage_id, t.version, t.direction, t.kind, t.status, t.created_at, t.closed_at, t.reason, ",".join(t.fired), t.supersedes, t.superseded_by, *listed, t.seal)

    def _refused(self, at: int, thesis_id: str, why: str) -> list[tuple]:
        return [self._event(at, thesis_id, "refused", why)]

    def _unfit(self, thesis_id: str) -> str | None:
        t = self.theses.get(thesis_id)
        if t is None:
            return "no such thesis"
        if t.status != "active":
            return f"closed: {t.reason}"
        return "broken seal" if self.seals[thesis_id] != t.seal else None

    def open(self, at: int, t: Thesis) -> list[tuple]:
        if t.thesis_id in self.theses:
            return self._refused(at, t.thesis_id, "the id is taken")
        if not t.confirmation or not t.invalidation:
            return self._refused(at, t.thesis_id, "rules are missing")
        self.theses[t.thesis_id], self.seals[t.thesis_id] = t, t.seal
        return [self._event(at, t.thesis_id, "opened", f"version={t.version}"), self._version(at, t)]

    def append(self, at: int, thesis_id: str, text: str, counter: bool = False) -> list[tuple]:
        if why := self._unfit(thesis_id):
            return self._refused(at, thesis_id, why)
        t = self.theses[thesis_id]
        (t.counter if counter else t.evidence).append(text)
        return [self._event(at, thesis_id, "evidence_appended", text), self._version(at, t)]

    def close(self, at: int, thesis_id: str, reason: str = "retired", fired: tuple[str, ...] = (), by: str | None = None, detail: str | None = None) -> list[tuple]:
        if why := self._unfit(thesis_id):
            return self._refused(at, thesis_id, why)
        t = self.theses[thesis_id]
        t.status, t.closed_at, t.reason, t.fired, t.superseded_by = "closed", at, reason, list(fired), by
        action = {"invalidation_fired": "invalidated", "superseded": "superseded"}.get(reason, "closed")
        return [self._event(at, thesis_id, action, detail or reason), self._version(at, t)]

    def fire(self, at: int, thesis_id: str, timeframe: str, h: float, l: float, c: float) -> list[tuple]:  # noqa: E741
        if why := self._unfit(thesis_id):
            return self._refused(at, thesis_id, why)
        fired = tuple(r["id"] for r in self.theses[thesis_id].invalidation if fires(r, timeframe, h, l, c))
        return self.close(at, thesis_id, "invalidation_fired", fired) if fired else []

    def revise(self, at: int, thesis_id: str, confirmation: list[dict] | None, invalidation: list[dict] | None, kind: str | None, why: str = "reasoning_changed") -> list[tuple]:
        """A successor with other rules, and the end of this version."""
        if unfit := self._unfit(thesis_id):
            return self._refused(at, thesis_id, unfit)
        old = self.theses[thesis_id]
        new = (confirmation or old.confirmation, invalidation or old.invalidation, kind or old.kind)
        if new == (old.confirmation, old.invalidation, old.kind):
            return self._refused(at, thesis_id, "no rule changes")
        n = old.version + 1
        follower = Thesis(f"{old.lineage_id}-v{n}", old.lineage_id, n, old.direction, new[2], at, new[0], new[1], list(old.evidence), list(old.counter), supersedes=old.thesis_id)
        return self.open(at, follower) + self.close(at, thesis_id, "superseded", by=follower.thesis_id, detail=why)

    def move(self, at: int, thesis_id: str, rule_id: str, price: float) -> list[tuple]:
        """Never done."""
        return [self._event(at, thesis_id, "rejected_invalidation_move", f"{rule_id}->{price}")]


def _rules(listed) -> list[dict] | None:
    return None if listed is None else [rule(*(r[k] for k in ("id", "kind", "price", "timeframe", "description"))) for r in listed]


#: A command: fields that its op does not need are null.
COMMANDS = """symbol string, seq long, at long, op string, thesis_id string, lineage_id string, direction string, kind string, text string, rule_id string, price double, timeframe string, h double, l double, c double,
    confirmation array<struct<id: string, kind: string, price: double, timeframe: string, description: string>>, invalidation array<struct<id: string, kind: string, price: double, timeframe: string, description: string>>"""


def ledger(commands: DataFrame) -> DataFrame:
    """Events and versions of commands (COMMANDS) in order of seq; op is open, evidence, counter, fire, close, revise or move."""

    def machine():
        own: list[Ledger] = []

        def step(r) -> list[tuple]:
            if not own:
                own.append(Ledger(r.symbol))
            book, t = own[0], r.thesis_id
            match r.op:
                case "open":
                    return book.open(r.at, Thesis(t, r.lineage_id, 1, r.direction, r.kind, r.at, _rules(r.confirmation) or [], _rules(r.invalidation) or [], [r.text] if r.text else []))
                case "evidence" | "counter":
                    return book.append(r.at, t, r.text, r.op == "counter")
                case "fire":
                    return book.fire(r.at, t, r.timeframe, r.h, r.l, r.c)
                case "close":
                    return book.close(r.at, t, r.text or "retired")
                case "revise":
                    return book.revise(r.at, t, _rules(r.confirmation), _rules(r.invalidation), r.kind, r.text or "reasoning_changed")
                case "move":
                    return book.move(r.at, t, r.rule_id, r.price)
            return book._refused(r.at, t, f"no such op: {r.op}")

        return step

    return sorted_pass(commands, ["symbol"], ["seq"], machine, SCHEMA)


def with_structure(bars: DataFrame, last: int | None = None) -> DataFrame:
    """bars with top and bottom: the extremes of the pivots known at the bar, or of all highs and lows where there is none; of the ``last`` bars, or of all up to it. A flat one is opened by GAP."""
    s = Window.partitionBy("symbol").orderBy("t")
    w = s.rowsBetween(Window.unboundedPreceding if last is None else 1 - last, 0)
    # a pivot is known with the third bar after it; with ``last``, it and its neighbours have to be among these
    inner = s.rowsBetween(Window.unboundedPreceding if last is None else 1 - last + 6, 0)
    found = confirmed_pivots(bars).groupBy("symbol", F.col("known_t").alias("t")).agg(F.max(F.when(F.col("kind") == "high", F.col("price"))).alias("_hi"), F.min(F.when(F.col("kind") == "low", F.col("price"))).alias("_lo"))
    df = bars.join(found, ["symbol", "t"], "left")
    top, bottom = F.coalesce(F.max("_hi").over(inner), F.max("h").over(w)), F.coalesce(F.min("_lo").over(inner), F.min("l").over(w))
    df = df.withColumns({"top": top, "bottom": bottom}).drop("_hi", "_lo")
    return df.withColumn("top", F.when(F.col("top") <= F.col("bottom"), F.col("bottom") * GAP).otherwise(F.col("top")))


def _opened(symbol: str, label: str, direction: str, kind: str, version: int, at: int, top: float, bottom: float, evidence: str, counter: str) -> Thesis:
    """A bear thesis stands on the loss of the bottom and falls with the top, a bull one the other way round."""
    sides = {"above": ("close_above", top), "below": ("close_below", bottom)}
    confirm, fail = ("below", "above") if direction == "bear" else ("above", "below")
    says = {
        ("bear", 0): f"{label} acceptance below structure low {bottom:.4f}",
        ("bear", 1): f"{label} reclaim of structure high {top:.4f}",
        ("bull", 0): f"{label} acceptance above structure high {top:.4f}",
        ("bull", 1): f"{label} loss of structure low {bottom:.4f}",
    }
    lineage = f"{symbol}:{label}:{direction}:{kind}"
    rules = [[rule(f"{direction}-{what}-{label}", *sides[side], label, says[direction, i])] for i, (what, side) in enumerate((("confirm", confirm), ("invalidate", fail)))]
    return Thesis(f"{lineage}:v{version}", lineage, version, direction, kind, at, *rules, [evidence], [counter])


def rebuilt_theses(states: DataFrame, label: str) -> DataFrame:
    """Events and versions of the theses that bars (symbol, t, known, h, l, c, regime, top, bottom) open: a bear one in a bearish, a bull one in a bullish regime, where none is live.

    Before that a bar fires the live theses' invalidation, so that one bar can end a version and open the next.
    """

    def machine():
        own: list = []

        def step(r) -> list[tuple]:
            if not own:
                own.extend([Ledger(r.symbol), {}, {"bear": 0, "bull": 0}])
            book, live, versions = own
            out = []
            for direction, thesis_id in list(live.items()):
                out += book.fire(r.known, thesis_id, label, r.h, r.l, r.c)
                if book.theses[thesis_id].status == "closed":
                    # a closed version is in the rows that were given; the fold does not keep it
                    del live[direction], book.theses[thesis_id], book.seals[thesis_id]
            want = {"bearish": "bear", "bullish": "bull"}.get(r.regime)
            if want and want not in live:
                versions[want] += 1
                kind = "htf_continuation" if versions[want] == 1 else "htf_continuation_reopened"
                t = _opened(r.symbol, label, want, kind, versions[want], r.known, r.top, r.bottom, f"{label} regime {r.regime} at {r.known}", "competing thesis and lower-timeframe bounce risk")
                live[want] = t.thesis_id
                out += book.open(r.known, t)
            return out

        return step

    return sorted_pass(states, ["symbol"], ["t"], machine, SCHEMA)


def relief_theses(states: DataFrame) -> DataFrame:
    """Per bar (symbol, t, h, l, c, regime, and bear_live: whether a bear thesis of the parent is live) in a relief: relief_t, confirm_price, invalid_price, closed_t.

    The thesis opens at the first bar of a relief among the last TAIL ones, with the structure of the RELIEF_STRUCTURE bars up to it, and closes with the first close below its low.
    """
    s = Window.partitionBy("symbol").orderBy("t")
    df = with_structure(states, RELIEF_STRUCTURE)
    seen = F.collect_list(F.struct("t", "c", "top", "bottom", F.col("regime").isin(*RELIEF).alias("relief"))).over(s.rowsBetween(1 - TAIL, 0))
    df = df.withColumn("tail", seen).where(F.col("bear_live") & F.col("regime").isin(*RELIEF))
    df = df.withColumn("first", F.get(F.filter("tail", lambda x: x["relief"]), F.lit(0)))
    lost = F.filter("tail", lambda x: (x["t"] >= F.col("first.t")) & (x["c"] < F.col("first.bottom")))
    return df.select("symbol", "t", F.col("first.t").alias("relief_t"), F.col("first.top").alias("confirm_price"), F.col("first.bottom").alias("invalid_price"), F.get(lost, F.lit(0))["t"].alias("closed_t"))
