"""The fold on a stream of events in any order, however late: records are told at once and corrected later.

Events need no places made beforehand. One that is not before its user's last event is folded where
it comes. One that is goes into its place by time: the state of the last rung before it is taken, and the
events from there on are folded again. A record that comes out other than it was told is told again with
a higher revision, so the rows with the highest revision of each event (latest()) are at any time the
records of a batch over what has come. Nothing waits for a missing event, nothing is dropped, and
there is no watermark.

What a user's state holds, each part written only where it changes:

* events and told records in spans of time: an event in place writes its own span;
* the vectors and contexts of active rows and the vectors of items, one entry for each;
* the head: ratings, active rows, interests and counters;
* rungs: earlier heads, as many as the logarithm of the events, spaced ever wider, so that an event m
  events late is followed by at most about 2 m foldings.

Up to SMALL events all of this is one value with the head, without what its items give again (vectors, contexts): an entry
of its own costs a call to the state store each time that it is read or written.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, MutableMapping

import numpy as np
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .state import COLUMNS, EVENT, RECORD, Options, UserState, located, step, told_row

REVISED = RECORD + ", revision bigint"
#: Seconds of a span, and events from a rung to the next.
SPAN, EVERY = 86_400.0, 32
#: Events of a user up to which the log is one value.
SMALL = 256
FIRST = (float("-inf"), 0, 0)


class Stored(MutableMapping):
    """A map kept entry by entry: entries are read when asked for and written, if they changed, by flush()."""

    def __init__(self, store):
        self.store, self.near, self.dirty = store, {}, set()
        self.written = 0

    def __getitem__(self, key):
        if key not in self.near:
            if not self.store.containsKey((key,)):
                raise KeyError(key)
            self.near[key] = pickle.loads(self.store.getValue((key,))[0])
        if self.near[key] is None:
            raise KeyError(key)
        return self.near[key]

    def __setitem__(self, key, value) -> None:
        self.near[key] = value
        self.dirty.add(key)

    def __delitem__(self, key) -> None:
        self[key]  # an entry that is not there raises
        self.near[key] = None
        self.dirty.add(key)

    def __contains__(self, key) -> bool:
        try:
            self[key]
        except KeyError:
            return False
        return True

    def __iter__(self):
        gone = {k for k, v in self.near.items() if v is None}
        here = set(self.near) - gone
        yield from here
        for (key,) in self.store.keys():
            if key not in self.near:
                yield key

    def __len__(self) -> int:
        return sum(1 for _ in self)

    def flush(self) -> None:
        for key in self.dirty:
            if self.near[key] is not None:
                value = pickle.dumps(self.near[key])
                self.written += len(value)
                self.store.updateValue((key,), (value,))
            elif self.store.containsKey((key,)):
                self.store.removeKey((key,))
        self.dirty.clear()


PARTS = ("items", "vectors", "contexts", "events", "told", "rungs")


def key_of(event: tuple) -> tuple:
    return event[:3]


def span_of(event: tuple) -> int:
    return int(event[0] // SPAN)


def rungs_kept(n: int, places: list[int]) -> list[int]:
    """Of rungs at these numbers of events, those to keep when there are n: a rung that is divisible by a
    higher power of two stays longer."""
    return [p for p in places if (n - p) // EVERY < 2 * ((p // EVERY) & -(p // EVERY))]


class Log:
    """One user: the state after all events that have come, and what it takes to put an event before others."""

    def __init__(self, head: tuple[UserState, tuple, list[int]] | None, stores: dict[str, MutableMapping], o: Options, bare: bool = False):
        self.state, self.last, self.places = head or (UserState(), FIRST, [])
        self.s, self.o, self.folded = stores, o, 0
        #: Whether the vectors and contexts of the active rows are still to be made.
        self.bare = bare
        self.bind()

    def bind(self) -> None:
        for name in ("items", "vectors", "contexts"):
            setattr(self.state, name, self.s[name])

    def head(self) -> tuple:
        """The state without its parts that are kept by entry."""
        bare = UserState(**{**self.state.__dict__, "items": {}, "vectors": {}, "contexts": {}})
        return bare, self.last, self.places

    def span(self, part: str, at: int) -> dict:
        """Raw id -> event or told record, of a span; to be put back when it changes."""
        return self.s[part][at] if at in self.s[part] else {}

    def fold(self, event: tuple) -> Iterator[dict]:
        """One event after the last; tells its record if it is another than before."""
        self.folded += 1
        record = step(self.state, event, self.o)
        self.last = key_of(event)
        at, raw = span_of(event), event[2]
        told = self.span("told", at)
        revision, before = told.get(raw, (-1, None))
        if before != record:
            self.s["told"][at] = {**told, raw: (revision + 1, record)}
            yield {**record, "revision": revision + 1}
        n = len(self.state.ratings)
        if n % EVERY == 0:
            self.s["rungs"][n] = pickle.dumps(self.head()[:2])
            kept = rungs_kept(n, [*(p for p in self.places if p < n), n])
            for p in set(self.places) - set(kept):
                self.s["rungs"].pop(p, None)
            self.places = kept

    def rewound(self, key: tuple) -> None:
        """The state as it was at the last rung before a key."""
        state, last, below = UserState(), FIRST, sorted(self.places)
        while below:
            state, last = pickle.loads(self.s["rungs"][below[-1]])
            if last < key:
                break
            self.s["rungs"].pop(below.pop())
            state, last = UserState(), FIRST
        self.state, self.last, self.places = state, last, below
        self.embed()

    def embed(self) -> None:
        """Contexts and vectors of just the active rows."""
        contexts, active = {}, self.state.active
        for i, k in enumerate(active):
            contexts[k[2]] = (k[0], *(x[1] for x in active[max(0, i - self.o.length + 1) : i + 1]))
        for raw in [r for r in self.s["contexts"] if r not in contexts]:
            del self.s["contexts"][raw]
            self.s["vectors"].pop(raw, None)
        for raw, context in contexts.items():
            if self.s["contexts"].get(raw) != context:
                self.s["contexts"][raw] = context
                self.s["vectors"][raw] = self.o.encode(np.stack([self.s["items"][m] for m in context[1:]]))
        self.bare = False
        self.bind()

    def after(self, key: tuple) -> list[tuple]:
        """All events after a key, in order."""
        first = int(key[0] // SPAN) if key[0] > float("-inf") else None
        spans = [a for a in self.s["events"] if first is None or a >= first]
        return sorted((e for a in spans for e in self.s["events"][a].values() if key_of(e) > key), key=key_of)

    def receive(self, events: list[tuple]) -> Iterator[dict]:
        """Events in any order; yields new and corrected records, a duplicate's with revision -1."""
        new, ids = [], set()
        for e in events:
            own = self.span("events", span_of(e))
            if e[2] in self.state.ids or e[2] in ids:
                yield {"event_id": e[2], "status": "duplicate", "revision": -1}
                continue
            self.s["events"][span_of(e)] = {**own, e[2]: e}
            new.append(e)
            ids.add(e[2])
        if not new:
            return
        new.sort(key=key_of)
        again = new
        if key_of(new[0]) < self.last:
            self.rewound(key_of(new[0]))
            again = self.after(self.last)
        elif self.bare:
            self.embed()
        for e in again:
            yield from self.fold(e)


def packed(log: Log) -> dict[str, dict]:
    """The parts of a log in memory that the rest does not give; an event's vector is its item's."""
    events = {at: {raw: (*e[:4], e[4] is not None) for raw, e in span.items()} for at, span in log.s["events"].items()}
    return {"items": dict(log.s["items"]), "events": events, "told": dict(log.s["told"]), "rungs": dict(log.s["rungs"])}


def unpacked(parts: dict[str, dict]) -> dict[str, dict]:
    items = parts["items"]
    events = {at: {raw: (*e[:4], items[e[1]] if e[4] else None) for raw, e in span.items()} for at, span in parts["events"].items()}
    return {**parts, "events": events, "vectors": {}, "contexts": {}}


def taken(value: bytes | None, entries: Callable[[], dict[str, Stored]], o: Options) -> Log:
    """A log from its value; entries gives the maps of one that is not small."""
    head, parts = (None, {p: {} for p in PARTS}) if value is None else pickle.loads(value)
    return Log(head, entries() if parts is None else unpacked(parts), o, bare=parts is not None)


def put_away(log: Log, entries: Callable[[], dict[str, Stored]]) -> bytes:
    """The value of a log; one that is not small writes the rest of it by entry."""
    if isinstance(log.s["events"], dict):
        if len(log.state.ratings) <= SMALL:
            return pickle.dumps((log.head(), packed(log)))
        if log.bare:
            log.embed()
        whole, log.s = log.s, entries()
        for name, part in whole.items():
            for key, value in part.items():
                log.s[name][key] = value
        log.bind()
    for s in log.s.values():
        s.flush()
    return pickle.dumps((log.head(), None))


class LateFold(StatefulProcessor):
    """A user's log as a stateful operator."""

    def __init__(self, o: Options):
        self.o = o

    def init(self, handle) -> None:
        self.head = handle.getValueState("head", "head binary")
        self.maps = {p: handle.getMapState(p, "key bigint", "value binary") for p in PARTS}

    def entries(self) -> dict[str, Stored]:
        return {p: Stored(m) for p, m in self.maps.items()}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        got = self.head.get()
        log = taken(None if got is None else got[0], self.entries, self.o)
        out = list(log.receive([(x.ts_s, x.movie_id, x.event_id, x.rating, None if x.vec is None else np.asarray(x.vec, dtype=np.float64)) for x in rows]))
        self.head.update((put_away(log, self.entries),))
        yield from (told_row(int(key[0]), r, [*COLUMNS, "revision"]) for r in out)

    def close(self) -> None:
        pass


def fold_late(events: DataFrame, items: DataFrame, o: Options) -> DataFrame:
    """Records with revisions of a stream of events (user_id, event_id, movie_id, ts_s, rating) in any order."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = located(events.withColumn("user_seq", F.lit(0).cast("bigint")), items).select(*EVENT)
    return rows.groupBy("user_id").transformWithState(LateFold(o), REVISED, "Append", "None")


def latest(records: DataFrame) -> DataFrame:
    """The record of each event as it was told last."""
    rest = [c for c in COLUMNS if c not in ("user_id", "event_id")]
    best = records.where("revision >= 0").groupBy("user_id", "event_id").agg(F.max_by(F.struct(*rest), "revision").alias("_r"))
    return best.select("user_id", "event_id", *(F.col(f"_r.{c}").alias(c) for c in rest))


def by_time(events: DataFrame) -> DataFrame:
    """events with user_seq, their places by time: what the batch over the same events needs."""
    order = Window.partitionBy("user_id").orderBy("ts_s", "movie_id", "event_id")
    return events.withColumn("user_seq", F.row_number().over(order).cast("bigint") - 1)
