"""The state machine of one user: ratings in, positives, embeddings, assignments and refits out.

The same fold runs over a batch (rows in order of user and place) and over a stream (state by user).
All that it needs between events is in UserState, which is kept as bytes. Every event brings the
vector of its own item, so the catalogue is joined, not collected.

Each event has a place in its user's log (user_seq). An event that comes before its predecessors
waits in the state until they have come, so the records of a stream do not depend on the order in
which its files are read. An event whose place has been taken is a duplicate and changes nothing.

What an event changes is found from sorted lists: the ratings between the old and the new mean turn
positive or cease to be, and only contexts within reach of such a row are embedded again. A context that changed
loses its vector; it gets the new one when an assignment or a refit reads it, those of a refit together.
"""

from __future__ import annotations

import pickle
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import Broadcast
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.clustering import cluster, pca, project
from ..operators.encoding import TOGETHER, recency_mean
from ..session import scratch


@dataclass(frozen=True)
class Options:
    """Thresholds of the state machine, and its encoder of a context's item vectors."""

    length: int = 10
    threshold: float = 0.2
    #: Active rows that a refit needs, and rows that must wait for one to be asked for (the same unless given).
    refit_min: int = 20
    pending_trigger: int | None = None
    assign_trigger: int = 50
    outlier_trigger: int = 10
    min_cluster: int = 3
    forced_every: int | None = None
    encode: Callable[[np.ndarray], np.ndarray] = recency_mean
    #: Whether records carry the interests and the seen items, for recommendations after the event.
    recommend: bool = False
    #: Whether records carry the decisions on single rows, for a history of them.
    decide: bool = False

    @property
    def waiting(self) -> int:
        return self.refit_min if self.pending_trigger is None else self.pending_trigger


Key = tuple[float, int, int]  # ts, movie, raw id
SMALL = 10**16  # a variance up to one in so many is no spread


def written_as(rating: float) -> tuple[int, int]:
    """(digits, places) of the decimal that a rating is written as: digits / 10**places."""
    text = repr(rating)
    whole, dot, part = text.partition(".")
    if dot and part.isdigit():
        return (int(whole), 0) if part == "0" else (int(whole + part), len(part))
    exact, places = Fraction(text), 0
    while 10**places % exact.denominator:
        places += 1
    return exact.numerator * (10**places // exact.denominator), places


@dataclass
class UserState:
    ratings: list[tuple[float, float, int, int]] = field(default_factory=list)  # rating and key, sorted
    ids: set[int] = field(default_factory=set)
    total: int = 0  # sum of the ratings, in units of 10**-places
    squares: int = 0  # sum of their squares, in units of 10**-(2 * places)
    places: int = 0
    items: dict[int, np.ndarray] = field(default_factory=dict)  # vectors of the known items met so far
    liked: dict[int, int] = field(default_factory=dict)  # movie -> its positive events, unknown items too
    active: list[Key] = field(default_factory=list)  # known positives, sorted
    contexts: dict[int, tuple] = field(default_factory=dict)  # active raw id -> its context
    vectors: dict[int, np.ndarray] = field(default_factory=dict)  # of contexts, none where it is still to be made
    interests: list[np.ndarray] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)
    reducer: tuple[np.ndarray, np.ndarray] | None = None
    pending: set[int] = field(default_factory=set)
    processed: set[int] = field(default_factory=set)
    assigned: int = 0
    outliers: int = 0
    required: bool = False
    open: bool = False
    reasons: set[str] = field(default_factory=set)
    version: int = 0
    next: int = 0  # place of the event that comes next
    held: dict[int, tuple] = field(default_factory=dict)  # events that wait, by place
    stacked: tuple | None = None  # interests, and these as a matrix with the norms of its rows

    def bar(self) -> float | None:
        """The mean that a positive rating exceeds; None while all are positive (few, or no spread).

        Ratings count as the decimals that they are written as, so one that equals the mean does not exceed it.
        """
        n = len(self.ratings)
        unit = 10**self.places
        if n < 3 or (self.squares * n - self.total**2) * SMALL <= (n * unit) ** 2:
            return None
        return self.total / (n * unit)

    def directions(self) -> tuple[np.ndarray, np.ndarray]:
        """The interests as a matrix, and the norms of its rows."""
        if self.stacked is None or self.stacked[0] is not self.interests:
            m = np.stack(self.interests)
            self.stacked = self.interests, m, np.linalg.norm(m, axis=1)
        return self.stacked[1:]

    def count_in(self, rating: float) -> None:
        """Add a rating to the sums."""
        digits, places = written_as(rating)
        if places > self.places:
            finer = 10 ** (places - self.places)
            self.total, self.squares, self.places = self.total * finer, self.squares * finer**2, places
        digits *= 10 ** (self.places - places)
        self.total += digits
        self.squares += digits * digits


def insert(state: UserState, event: tuple, o: Options) -> tuple[bool, list[Key], list[int]]:
    """Add a rating (ts, movie, raw id, rating, item vector or None).

    Returns whether it is positive, the rows whose context changed, and the raw ids that left.
    """
    positive, changed, left = moved(state, event, o)
    embedded(state, [k[2] for k in changed], o)
    return positive, changed, left


def embedded(state: UserState, raws: list[int], o: Options) -> list[np.ndarray]:
    """The vectors of active rows; those that are still to be made are encoded first, contexts of one length together."""
    stale: dict[int, list[int]] = {}
    for raw in raws:
        if raw not in state.vectors:
            stale.setdefault(len(state.contexts[raw]), []).append(raw)
    many = TOGETHER.get(o.encode)
    for length, rows in stale.items():
        items = state.items
        x = np.concatenate([items[m] for raw in rows for m in state.contexts[raw][1:]]).reshape(len(rows), length - 1, -1)
        for raw, vec in zip(rows, map(o.encode, x) if many is None else many(x), strict=True):
            state.vectors[raw] = vec
    return [state.vectors[raw] for raw in raws]


def moved(state: UserState, event: tuple, o: Options) -> tuple[bool, list[Key], list[int]]:
    """As insert(), but the rows whose context changed are left without vectors."""
    ts, movie, raw, rating, vec = event
    before = state.bar()
    state.count_in(rating)
    if vec is not None:
        state.items.setdefault(movie, np.asarray(vec, dtype=np.float64))
    own = (rating, ts, movie, raw)
    insort(state.ratings, own)
    state.ids.add(raw)
    after, every = state.bar(), state.ratings
    # what the bar's move turns over among the ratings so far
    rating_of = lambda x: x[0]
    on: list[tuple] = []
    off: list[tuple] = []
    if before is None or after is None:
        if (before is None) != (after is None):
            under = every[: bisect_right(every, after if before is None else before, key=rating_of)]
            (off if before is None else on).extend(x for x in under if x is not own)
    elif after > before:
        off = [x for x in every[bisect_right(every, before, key=rating_of) : bisect_right(every, after, key=rating_of)] if x is not own]
    elif after < before:
        on = [x for x in every[bisect_right(every, after, key=rating_of) : bisect_right(every, before, key=rating_of)] if x is not own]
    positive = after is None or rating > after
    if positive:
        on.append(own)
    touched: set[Key] = set()
    left = []
    for x in off:
        key = x[1:]
        state.liked[key[1]] -= 1
        if not state.liked[key[1]]:
            del state.liked[key[1]]
        if key[1] in state.items:
            at = bisect_left(state.active, key)
            del state.active[at]
            touched.update(state.active[at : at + o.length - 1])
            state.contexts.pop(key[2])
            state.vectors.pop(key[2], None)
            left.append(key[2])
    for x in on:
        key = x[1:]
        state.liked[key[1]] = state.liked.get(key[1], 0) + 1
        if key[1] in state.items:
            at = bisect_left(state.active, key)
            state.active.insert(at, key)
            touched.update(state.active[at : at + o.length])
    gone, changed, active, reach = set(left), [], state.active, o.length - 1
    for key in sorted(touched):
        if key[2] in gone:
            continue
        at = bisect_left(active, key)
        context = (key[0], *[k[1] for k in active[max(0, at - reach) : at + 1]])
        if state.contexts.get(key[2]) != context:
            state.contexts[key[2]] = context
            state.vectors.pop(key[2], None)
            changed.append(key)
    return positive, changed, left


def assign(state: UserState, raw: int, vec: np.ndarray | None, o: Options) -> tuple[str, int | None, float | None]:
    """Status, nearest interest and similarity of one changed row; without a vector, by that of its context."""

    def wait(outlier: bool) -> None:
        if outlier and raw not in state.pending:
            state.outliers += 1
        state.pending.add(raw)

    if raw in state.processed:
        return "skipped_processed", None, None
    if not state.interests:
        wait(False)
        return ("pending_refit_required" if len(state.pending) >= o.waiting else "pending_no_interest"), None, None
    if vec is None:
        vec = embedded(state, [raw], o)[0]
    m, norms = state.directions()
    sims = m @ vec / np.maximum(norms * np.sqrt(vec @ vec), 1e-8)
    if not np.isfinite(sims).all():
        wait(True)
        return "outlier_invalid", None, None
    best = int(sims.argmax())
    if sims[best] < o.threshold:
        wait(True)
        return "outlier", best, float(sims[best])
    state.pending.discard(raw)
    state.processed.add(raw)
    state.assigned += 1
    state.counts[best] += 1
    return "assigned", best, float(sims[best])


def triggers(state: UserState, o: Options) -> set[str]:
    out = set()
    if len(state.pending) >= o.waiting:
        out.add("pending_events" if state.interests else "no_interest_pending_events")
    if state.assigned >= o.assign_trigger:
        out.add("assigned_since_last_refit")
    if state.outliers >= o.outlier_trigger:
        out.add("outlier_since_last_refit")
    return out


def refit(state: UserState, o: Options) -> str:
    return refitted(state, o)[0]


def refitted(state: UserState, o: Options) -> tuple[str, list[int]]:
    """Skipped for few active rows (the reasons stay), else new interests from the clusters' means,
    or from the mean of all rows when all are noise, and a new 3-d projection. Also the active rows' labels."""
    state.open = False
    if len(state.active) < o.refit_min:
        state.required = True
        return "skipped", []
    x = np.stack(embedded(state, [k[2] for k in state.active], o))
    labels, *space = cluster(x, o.min_cluster)
    names = sorted(set(labels[labels >= 0].tolist()))
    state.interests = [x[labels == k].mean(axis=0) for k in names] or [x.mean(axis=0)]
    state.counts = [int((labels == k).sum()) for k in names] or [len(x)]
    state.reducer = tuple(space) if len(x) >= 5 else pca(x, min(3, len(x)))  # fewer rows are clustered in a smaller space
    state.pending, state.processed = set(), {k[2] for k in state.active}
    state.assigned = state.outliers = 0
    state.required, state.reasons = False, set()
    return "closed", labels.tolist()


def step(state: UserState, event: tuple, o: Options) -> dict:
    """One rating in its place; returns the record of what it led to."""
    raw = event[2]
    if raw in state.ids:
        return {"event_id": raw, "status": "duplicate"}
    positive, changed, inactive = moved(state, event, o)
    state.version += 1
    seen = {"assigned": 0, "outliers": 0}
    own, point = None, None
    decisions = [("inactivate", r, None) for r in inactive]
    for key in changed:
        status, best, _ = assign(state, key[2], None, o)
        if status == "assigned":
            decisions.append(("projection", key[2], best))
        seen["assigned"] += status == "assigned"
        seen["outliers"] += status.startswith("outlier")
        if key[2] == raw:
            own = status
            # an assigned row is drawn with the reducer of the last refit
            if status == "assigned" and state.reducer is not None:
                point = project(embedded(state, [raw], o)[0], *state.reducer).tolist()
    state.version += bool(changed)
    reasons = triggers(state, o)
    if o.forced_every and len(state.ratings) % o.forced_every == 0:
        reasons.add("forced")
    state.reasons |= reasons
    state.required = bool(state.reasons)
    outcome = None
    if state.required and not state.open:
        state.open = True
        outcome, labels = refitted(state, o)
        decisions += [("base", k[2], label) for k, label in zip(state.active, labels, strict=False)]
        state.version += 1
    out = {"event_id": raw, "status": own or ("unknown_item" if positive else "not_positive"), "changed": len(changed), "inactive": len(inactive), **seen}
    out |= {"active": len(state.active), "pending": len(state.pending), "refit": outcome, "interests": len(state.interests), "version": state.version, "point": point}
    if o.recommend:
        out |= {"vecs": [v.tolist() for v in state.interests], "seen": sorted(state.liked)}
    if o.decide:
        out["decisions"] = [{"kind": kind, "raw_id": r, "label": label} for kind, r, label in decisions]
    return out


RECORD = (
    "user_id bigint, event_id bigint, status string, changed bigint, inactive bigint, assigned bigint, outliers bigint, active bigint, pending bigint, "
    "refit string, interests bigint, version bigint, point array<double>, vecs array<array<double>>, seen array<bigint>, decisions array<struct<kind:string,raw_id:bigint,label:bigint>>"
)
COLUMNS = [c.split()[0] for c in RECORD.split(", ")]
EVENT = ["user_id", "user_seq", "event_id", "movie_id", "ts_s", "rating", "vec"]


def receive(state: UserState, seq: int, event: tuple, o: Options) -> Iterator[dict]:
    """The records that an event leads to: its own, and those of events that waited for it."""
    if seq < state.next or seq in state.held:
        yield {"event_id": event[2], "status": "duplicate"}
        return
    state.held[seq] = event
    while state.next in state.held:
        yield step(state, state.held.pop(state.next), o)
        state.next += 1


def told_row(user: int, record: dict, schema: list[str]) -> Row:
    """A record as a row of a stream; what it lacks is null."""
    return Row(**{"user_id": user, **{c: record.get(c) for c in schema if c != "user_id"}})


def rest(state: UserState, o: Options) -> Iterator[dict]:
    """The records of what still waits when no more will come: in order, whatever is missing between."""
    for seq in sorted(state.held):
        yield step(state, state.held.pop(seq), o)
        state.next = seq + 1


def whole_numbers(values: list) -> pd.arrays.IntegerArray:
    return pd.arrays.IntegerArray(np.array([0 if v is None else v for v in values], dtype=np.int64), np.array([v is None for v in values], dtype=bool))


def frame(user: int | list[int], rows: list[dict]) -> pd.DataFrame:
    """Records of one user, or of as many users as records, as a table; what a record lacks is null."""
    plain = ("status", "refit", "point", "vecs", "seen", "decisions")
    values = ((c, [r.get(c) for r in rows]) for c in COLUMNS[1:])
    columns = {c: pd.Series(v, dtype=object) if c in plain else whole_numbers(v) for c, v in values}
    return pd.DataFrame({"user_id": np.full(len(rows), user, dtype=np.int64) if isinstance(user, int) else np.array(user, dtype=np.int64), **columns})


def located(events: DataFrame, items: DataFrame) -> DataFrame:
    """events with the vector of their item, null where it is unknown."""
    return events.join(items.select("movie_id", "vec"), "movie_id", "left").select(*EVENT)


#: Numbers of the item matrix up to which every task may hold it, and rows of a table that a fold makes at once.
MATRIX, ROWS = 16_000_000, 2000


def vectors_of(items: DataFrame) -> Broadcast | None:
    """The vectors by item for every task, None if they are too many for that."""
    if (items.agg(F.sum(F.size("vec"))).first()[0] or 0) > MATRIX:
        return None
    known = items.select("movie_id", "vec").toPandas()
    return items.sparkSession.sparkContext.broadcast(dict(zip(known["movie_id"].tolist(), known["vec"].tolist(), strict=True)))


def stored_vectors(items: DataFrame) -> str | None:
    """As vectors_of(), as a table in the shared folder that tasks read by themselves; operators with state get no broadcasts."""
    if (items.agg(F.sum(F.size("vec"))).first()[0] or 0) > MATRIX:
        return None
    path = f"{scratch(items.sparkSession)}/vectors-{uuid.uuid4().hex}"
    items.select("movie_id", "vec").write.parquet(path)
    try:
        read_vectors(path)
    except (OSError, ValueError):  # a file system that only Spark reads
        return None
    return path


@lru_cache(maxsize=2)
def read_vectors(path: str) -> dict[int, np.ndarray]:
    system, at = fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)
    known = pq.read_table(at, filesystem=system)
    return {m: np.asarray(v, dtype=np.float64) for m, v in zip(known["movie_id"].to_pylist(), known["vec"].to_numpy(), strict=True)}


def packed(state: UserState, named: bool) -> bytes:
    """A state as bytes without what is made of the rest again; with named, items are ids, for tasks that hold their vectors."""
    slim = {**state.__dict__, "vectors": {}, "stacked": None}
    if named:
        slim |= {"items": list(state.items), "held": {seq: event[:4] for seq, event in state.held.items()}}
    return zlib.compress(pickle.dumps(slim), 1)


def unpacked(data: bytes, known: dict | None) -> UserState:
    state = UserState(**pickle.loads(zlib.decompress(data)))
    if isinstance(state.items, list):
        state.items = {m: np.asarray(known[m], dtype=np.float64) for m in state.items}
        state.held = {seq: (*event, known.get(event[1])) for seq, event in state.held.items()}
    return state


def by_user(events: DataFrame, items: DataFrame, o: Options, each: Callable[[UserState, list[dict]], list], last: Callable[[UserState, list[dict]], list], table: Callable[[list[int], list], pd.DataFrame], schema: str, dealt: bool = False) -> DataFrame:
    """A fold over the events of each user in order; a task holds one user's state at a time.

    each makes rows of the records of a batch, last of those at the end of a user; table puts rows, with their users, together.
    Events are dealt to tasks (unless they are dealt by user already) and sorted without their vectors, which every task
    holds by item, unless the items are too many for that.
    """
    shared = vectors_of(items)
    few = shared is not None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, state, users, rows = None, UserState(), [], []

        def put(own: list) -> None:
            users.extend([user] * len(own))
            rows.extend(own)

        def told(least: int) -> Iterator[pd.DataFrame]:
            if len(rows) >= least:
                yield table(users[:], rows[:])
                users.clear()
                rows.clear()

        for pdf in batches:
            own = pdf["movie_id"].map(shared.value.get) if few else pdf["vec"]
            columns = (pdf[c].tolist() for c in ("user_id", "user_seq", "ts_s", "movie_id", "event_id", "rating"))
            for name, seq, t, m, e, r, v in zip(*columns, own, strict=True):
                if name != user:
                    if user is not None:
                        put(last(state, list(rest(state, o))))
                    user, state = int(name), UserState()
                for record in receive(state, int(seq), (t, int(m), int(e), r, v), o):
                    put(each(state, [record]))
                    yield from told(ROWS)
        if user is not None:
            put(last(state, list(rest(state, o))))
        yield from told(1)

    ordered = lambda rows: rows.sortWithinPartitions("user_id", "user_seq", "event_id")
    spread = lambda rows: ordered(rows.where("user_id is not null").repartition("user_id"))
    rows = (ordered(events) if dealt else spread(events)).select(*EVENT[:-1]) if few else spread(located(events, items))
    return rows.mapInPandas(run, schema)


def fold_batch(events: DataFrame, items: DataFrame, o: Options, dealt: bool = False) -> DataFrame:
    """The records of all events; each user's are folded in order of place, a batch of rows at a time.

    dealt says that each user's events are in one partition, as those of replay.user_log() are.
    """
    records = lambda _, rows: rows
    return by_user(events, items, o, records, records, frame, RECORD, dealt)


class Fold(StatefulProcessor):
    """The fold as a stateful operator; the state is one value of bytes by user, without the vectors that the table at known holds by item."""

    def __init__(self, o: Options, known: str | None = None):
        self.o, self.known = o, known

    def init(self, handle) -> None:
        self.state = handle.getValueState("state", "state binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        got, known = self.state.get(), None if self.known is None else read_vectors(self.known)
        state = UserState() if got is None else unpacked(got[0], known)
        events = ((x.user_seq, (x.ts_s, x.movie_id, x.event_id, x.rating, x.vec if known is None else known.get(x.movie_id))) for x in rows)
        out = [told_row(int(key[0]), r, COLUMNS) for seq, event in events for r in receive(state, seq, event, self.o)]
        self.state.update((packed(state, known is not None),))
        yield from out

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.state.update((bytes(initialState["state"]),))

    def close(self) -> None:
        pass


def fold_stream(events: DataFrame, items: DataFrame, o: Options, seed: DataFrame | None = None) -> DataFrame:
    """The same records from a stream, in whatever order the events come.

    seed (user_id, state) gives states to start from; it becomes the initial state of the operator.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    start = None if seed is None else seed.groupBy("user_id")
    known = stored_vectors(items)
    rows = located(events, items) if known is None else events.select(*EVENT[:-1])
    return rows.groupBy("user_id").transformWithState(Fold(o, known), RECORD, "Append", "None", initialState=start)


def seed_states(events: DataFrame, items: DataFrame, cutoff_s: float, o: Options) -> DataFrame:
    """(user_id, ratings, active, interests, state) at an exclusive cutoff: all active rows count as processed,
    nothing is pending, and the places of the log to come begin at 0."""
    quiet = Options(**{**o.__dict__, "refit_min": 10**12, "assign_trigger": 10**12, "outlier_trigger": 10**12, "forced_every": None, "recommend": False})
    schema = "user_id bigint, ratings bigint, active bigint, interests bigint, state binary"
    named = stored_vectors(items) is not None
    names = [c.split()[0] for c in schema.split(", ")]
    w = Window.partitionBy("user_id").orderBy("ts_s", "movie_id", "event_id")
    before = events.where(F.col("ts_s") < cutoff_s).withColumn("user_seq", F.row_number().over(w) - 1)

    def finish(state: UserState, _: list[dict]) -> list[tuple]:
        if state.active:
            refit(state, Options(**{**o.__dict__, "refit_min": 1}))
        state.pending, state.processed = set(), {k[2] for k in state.active}
        state.reasons, state.required, state.next = set(), False, 0
        return [(len(state.ratings), len(state.active), len(state.interests), packed(state, named))]

    table = lambda users, rows: pd.DataFrame([(u, *r) for u, r in zip(users, rows, strict=True)], columns=names)
    return by_user(before, items, quiet, lambda *_: [], finish, table, schema)
