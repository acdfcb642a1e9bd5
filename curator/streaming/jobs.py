"""Structured Streaming forms of ingest, dedup, gaps, periods and notices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curator import constants as K
from curator.functions.times import period_of
from curator.operators.filters import success_days, unblocked, window_filter, window_state
from curator.operators.ledger import period_label
from curator.runtime import materialize
from curator.streaming.core import append_table, each_batch, keyed_state, write_updates


#: Keys are folded in so many buckets: a call of Python handles all keys of one bucket, whose state is an entry per key.
#: The state of a checkpoint is kept by bucket, so the number stays what it is.
BUCKETS = 4096


def _bucket(key: Column | str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("bucket")


class _IngestState:
    """The contents of the keys of one bucket: what each held first."""

    columns = ["name", "hash", "row", "fresh"]

    def __init__(self, remember: float | None):
        self.remember = remember

    def init(self, handle) -> None:
        ttl = int(self.remember * 3_600_000) if self.remember else None
        self.state = handle.getMapState(
            "contents", T.StructType([T.StructField("name", T.StringType())]), T.StructType([T.StructField("hash", T.StringType())]), ttl)

    def handleInputRows(self, key, rows, timer_values):
        import pandas as pd

        known, held, best = self.state.exists(), {}, {}  # held: by name, None while new; best: the row of its least content so far
        for chunk in rows:
            chunk = chunk.drop_duplicates(["name", "hash"])
            others = []
            for name, content, row in zip(chunk["name"], chunk["hash"], chunk["row"], strict=True):
                if name not in held:
                    entry = self.state.getValue((name,)) if known else None
                    held[name] = entry[0] if entry else None
                if held[name] is None and name not in best:
                    best[name] = (content, row)
                elif held[name] is None and content < best[name][0]:
                    others.append((name, *best[name], False))
                    best[name] = (content, row)
                elif content != (best[name][0] if held[name] is None else held[name]):
                    others.append((name, content, row, False))
            if others:
                yield pd.DataFrame(others, columns=self.columns, dtype=object)
        for name, (content, _) in best.items():
            self.state.updateValue((name,), (content,))
        # Names the recorded contents for the conflicts of this batch.
        named = [(name, *best[name], True) if content is None else (name, content, None, None) for name, content in held.items()]
        yield pd.DataFrame(named, columns=self.columns, dtype=object)

    def close(self) -> None:
        pass


def stream_ingest(stream: DataFrame, path: str, checkpoint: str, key: str, content_hash: str, remember_hours: float | None = None):
    """Idempotent ingest: a replay is a no-op, changed content is a conflict.

    Rows go to `path/log`, conflicts to `path/conflicts`, one folder per micro-batch. What a key held first is keyed state
    in RocksDB, so the work of a micro-batch follows its own rows and not the log. A key is remembered for good, or for
    `remember_hours` after its content was recorded. Of several contents of a key in one micro-batch, which has no order,
    the least hash is its content; rows without a hash are passed over, null is a key. Keys are handled by bucket, the rows of
    a bucket in chunks, of which the best row of every key is kept.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("name")
    slim = stream.where(F.col(content_hash).isNotNull()).select(
        name, F.col(content_hash).cast("string").alias("hash"), F.struct(*stream.columns).alias("row"))
    kinds = T.StructType([*[T.StructField(f.name, f.dataType) for f in slim.schema.fields], T.StructField("fresh", T.BooleanType())])
    judged = slim.select("*", _bucket("name")).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_processor(_IngestState, remember_hours), outputStructType=kinds, outputMode="append",
        timeMode="processingTime" if remember_hours else "none")

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = materialize(batch, "ingest")  # read twice below
        batch.where("fresh").select("row.*").write.mode("overwrite").parquet(f"{path}/log/batch={batch_id}")
        held = batch.where("fresh is null or fresh").select("name", F.col("hash").alias("recorded_hash"))
        clash = batch.where("not fresh").select("name", "hash", F.col("row")[key].alias(key)).distinct()
        found = clash.join(held, "name").select(key, F.col("hash").alias(content_hash), "recorded_hash")
        found.write.mode("overwrite").parquet(f"{path}/conflicts/batch={batch_id}")

    with keyed_state(stream.sparkSession):
        return each_batch(judged, handle, checkpoint)


def stream_first_seen(stream: DataFrame, path: str, checkpoint: str, key: Sequence[str], discovered: str, payload: Sequence[str] = ()):
    """First sight of every identity; the earliest discovery is kept for good.

    A streaming minimum: partial results combine before the shuffle and only
    changed identities are written.
    """
    first = F.min(F.struct(discovered, *payload)).alias("_f")
    seen = stream.groupBy(*key).agg(first).select(*key, *[F.col(f"_f.{c}").alias(c) for c in (discovered, *payload)])
    return write_updates(seen, path, checkpoint)


# Why a feed may have lost releases.
NO_OVERLAP, LATE_WINDOW = "no_ledger_overlap", "feed_window_after_last_success"
UNCLOSED, FAILED, NO_BASELINE = "rest_backfill_unclosed", "rest_backfill_failed", "baseline_not_established"


class _InOrder:
    """Hands the rows of a key to a fold in order, in bounded memory.

    Up to `held_rows` rows are sorted in memory. More are put aside in keyed state, in pieces by a slot of the order (a prefix of
    its text), and taken back slot by slot; held are the names of the pieces and the rows of one slot.
    """

    order, slot, held_rows = "", 16, 50_000

    def __init__(self, held_rows: int | None = None):
        self.held_rows = held_rows or self.held_rows

    def init(self, handle) -> None:
        self.aside = handle.getMapState(
            "aside", T.StructType([T.StructField("slot", T.StringType()), T.StructField("piece", T.LongType())]),
            T.StructType([T.StructField("rows", T.BinaryType())]))
        self.begin(handle)

    def handleInputRows(self, key, rows, timer_values):
        import pickle

        import pandas as pd

        self.start()
        near, count, pieces = [], 0, 0
        for chunk in rows:
            near.append(chunk)
            count += len(chunk)
            if count <= self.held_rows:
                continue
            for part in near:
                slots = part[self.order].map(lambda x: f"{x:020d}" if isinstance(x, int) else str(x)).str[: self.slot]
                for slot, own in part.groupby(slots, sort=False):
                    self.aside.updateValue((slot, pieces), (pickle.dumps(own),))
                    pieces += 1
            near, count = [], self.held_rows  # from now on every chunk is put aside
        if not pieces:
            yield self.fold(key, pd.concat(near).sort_values(self.order, kind="stable"))
        else:
            named = sorted((k[0], k[1]) for k in self.aside.keys())
            at = 0
            while at < len(named):
                end = at
                while end < len(named) and named[end][0] == named[at][0]:
                    end += 1
                own = pd.concat([pickle.loads(self.aside.getValue(n)[0]) for n in named[at:end]])
                yield self.fold(key, own.sort_values(self.order, kind="stable"))
                at = end
            self.aside.clear()
        self.finish()

    def close(self) -> None:
        pass


class _GapState(_InOrder):
    """One source's anchor, last success and open gap, folded over its polls.

    A poll that is not later than the last closed one is late: it is judged, but moves neither the anchor nor the last success.
    """

    order = "polled_at"

    def begin(self, handle) -> None:
        self.state = handle.getValueState("gap", T.StructType([
            T.StructField("anchors", T.ArrayType(T.StringType())), T.StructField("last_success", T.StringType()),
            T.StructField("open_reason", T.StringType()),
        ]))

    def start(self) -> None:
        held = self.state.get()
        self.now = (list(held[0]), held[1], held[2]) if held else ([], None, None)

    def fold(self, key, polls):
        import pandas as pd

        anchors, last, reason = self.now
        out = []
        for poll in polls.itertuples():
            entries = [(e["key"], e["published_at"]) for e in poll.entries]
            stamps = sorted(p for _, p in entries if p)
            found = None
            if last and anchors:
                if not {k for k, _ in entries} & set(anchors):
                    found = NO_OVERLAP
                elif stamps and stamps[0] > last:
                    found = LATE_WINDOW
            if found and isinstance(poll.backfill, str):
                # What the backfill of a gap came to takes the place of the gap's own reason.
                found = {"closed": None, "unclosed": UNCLOSED}.get(poll.backfill, f"{FAILED}: {poll.backfill}")
            row = {"source_id": key[0], "polled_at": poll.polled_at, "oldest": stamps[0] if stamps else "", "newest": stamps[-1] if stamps else ""}
            out.append(row | {"has_gap": found is not None, "reason": found or ""})
            if not poll.baseline:
                out.append(row | {"has_gap": True, "reason": NO_BASELINE})
            if last and poll.polled_at <= last:
                continue
            reason = found
            if not found:
                # Only a closed feed moves the anchor; an open gap keeps the old one.
                anchors = [entries[0][0]] if entries else anchors
                last = poll.polled_at
        self.now = (anchors, last, reason)
        return pd.DataFrame(out, columns=GAP_SCHEMA.names)

    def finish(self) -> None:
        self.state.update(self.now)


GAP_SCHEMA = T.StructType([
    T.StructField("source_id", T.StringType()), T.StructField("polled_at", T.StringType()), T.StructField("has_gap", T.BooleanType()),
    T.StructField("reason", T.StringType()), T.StructField("oldest", T.StringType()), T.StructField("newest", T.StringType()),
])


def _processor(base: type, *args):
    from pyspark.sql.streaming import StatefulProcessor

    return type(base.__name__.strip("_"), (base, StatefulProcessor), {})(*args)


def stream_gaps(polls: DataFrame, path: str, checkpoint: str, held_rows: int | None = None):
    """Feed gaps per source: nothing overlaps the anchor, or the feed starts after
    the last success. A gap stays open, with its anchor, until a poll closes it.

    polls: source_id, polled_at (ISO text), entries ARRAY<STRUCT<key,
    published_at>> newest first, and either backfilled (a gap was closed by a
    backfill) or backfill: 'closed', 'unclosed', an error text, null for none. A
    poll with baseline = false has its own row, as nothing before it is known.
    One row per poll: a feed page has a bounded number of entries. The polls of a source in one micro-batch are handled in
    order of `polled_at`, at most `held_rows` of them in memory.
    """
    outcome = F.col("backfill") if "backfill" in polls.columns else F.when(F.col("backfilled"), "closed")
    baseline = F.coalesce("baseline", F.lit(False)) if "baseline" in polls.columns else F.lit(True)
    polls = polls.select("source_id", "polled_at", "entries", outcome.cast("string").alias("backfill"), baseline.alias("baseline"))
    gaps = polls.groupBy("source_id").transformWithStateInPandas(
        statefulProcessor=_processor(_GapState, held_rows), outputStructType=GAP_SCHEMA, outputMode="append", timeMode="none"
    )
    with keyed_state(polls.sparkSession):
        return append_table(gaps, path, checkpoint)


def stream_periods(stream: DataFrame, path: str, checkpoint: str, at: str, ranking_type: str, by: Sequence[str] = ()):
    """Counts per natural local day, Monday week or month, updated as rows arrive.

    State holds one row per period, so late rows still reach their own period.
    """
    counts = stream.groupBy(period_of(at, ranking_type).alias("period"), *by).agg(F.count(F.lit(1)).alias("n"))
    return write_updates(counts, path, checkpoint)


class _LifecycleState(_InOrder):
    """Current statuses of the releases of one bucket, re-opened by a policy or content change.

    Rows of one micro-batch are handled by `seq`; a row of a later micro-batch comes after them, whatever its `seq`.
    """

    order = "seq"

    def begin(self, handle) -> None:
        self.state = handle.getMapState("entries", T.StructType([T.StructField("name", T.StringType())]), T.StructType([
            T.StructField("status", T.StringType()), T.StructField("policy_version", T.StringType()), T.StructField("content_hash", T.StringType()),
        ]))

    def start(self) -> None:
        self.known, self.now, self.changed = self.state.exists(), {}, set()

    def entry(self, name: str) -> tuple:
        held = self.state.getValue((name,)) if self.known else None
        return tuple(held) if held else (None, None, None)

    def fold(self, key, rows):
        import pandas as pd

        out = []
        for row in rows.itertuples():
            name = "" if row.release_key is None else f"={row.release_key}"
            if name not in self.now:
                self.now[name] = self.entry(name)
            status, policy, content = self.now[name]
            if row.event == "decision":
                # A decision settles only what is waiting for one.
                new = {"accept": "accepted", "reject": "rejected"}.get(row.verdict) if status in ("pending_review", "review_failed") else None
            else:
                settled = (
                    status is not None and policy == row.policy_version and status not in ("pending_review", "review_failed")
                    and not (row.item_type == "security" and content != row.content_hash)
                )
                new = None if settled else row.verdict
            if new is None:
                continue
            if row.event != "decision":
                policy, content = row.policy_version, row.content_hash
            self.now[name] = (new, policy, content)
            self.changed.add(name)
            out.append({"release_key": row.release_key, "seq": row.seq, "status": new, "policy_version": policy})
        return pd.DataFrame(out, columns=["release_key", "seq", "status", "policy_version"])

    def finish(self) -> None:
        for name in self.changed:
            self.state.updateValue((name,), self.now[name])


LIFECYCLE_SCHEMA = T.StructType([
    T.StructField("release_key", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("status", T.StringType()),
    T.StructField("policy_version", T.StringType()),
])


def stream_ledger(stream: DataFrame, path: str, checkpoint: str, held_rows: int | None = None):
    """Status log of releases: one row per status change.

    stream: release_key, seq, event ('record' or 'decision'), verdict (for a
    record: pending_review, filtered, withdrawn or no_longer_qualifying; for a
    decision: accept or reject), policy_version, content_hash, item_type. Releases are handled by bucket, at most `held_rows`
    rows of one in memory, and what is held of each of its releases in the micro-batch.
    """
    rows = stream.select("release_key", "seq", "event", "verdict", "policy_version", "content_hash", "item_type", _bucket("release_key"))
    log = rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_processor(_LifecycleState, held_rows), outputStructType=LIFECYCLE_SCHEMA, outputMode="append", timeMode="none"
    )
    with keyed_state(stream.sparkSession):
        return append_table(log, path, checkpoint)


def stream_lookback(stream: DataFrame, source_state: DataFrame, path: str, checkpoint: str, source: str, at: str, now: Column):
    """Rows inside the lookback of their source: 48 hours, or 168 after a recent failure.

    source_state: source, status, completed_at.
    """
    recent = F.col("completed_at").between(now - F.expr(f"INTERVAL {K.FALLBACK_DAYS} DAYS"), now)
    hours = source_state.select(
        source, F.when((F.col("status") == "failed") & recent, K.FALLBACK_HOURS).otherwise(K.LOOKBACK_HOURS).alias("lookback_hours")
    )
    # No source looks back further than the fallback: this much the scan can skip.
    recent_rows = window_filter(stream, at, now, K.FALLBACK_HOURS)
    joined = recent_rows.join(hours, source, "left").fillna({"lookback_hours": K.LOOKBACK_HOURS})
    kept = joined.where(window_state(F.col(at), now, F.col("lookback_hours")).isin("inside", "unknown"))
    return append_table(kept, path, checkpoint)


def stream_late_label(stream: DataFrame, path: str, checkpoint: str, event_at: str, first_discovered: str, start: Column, end: Column):
    """Rows with the period of their event and how their discovery relates to it."""
    labelled = stream.withColumn("event_period", period_of(event_at, "monthly")).withColumn(
        "period_label", period_label(F.col(first_discovered), start, end)
    )
    return append_table(labelled, path, checkpoint)


def stream_suppress(stream: DataFrame, log: DataFrame, path: str, checkpoint: str, key: str, at: str, days: int):
    """Rows whose key had no success in the `days` days before them (see `cooled_down`).

    The log is reduced once, when the job starts; every micro-batch is joined with that table.
    """
    near = materialize(success_days(log, key, at, days), "success-days")
    return append_table(unblocked(stream, near, key, at, days), path, checkpoint)


def stream_suppress_growing(
    stream: DataFrame, log: DataFrame, path: str, checkpoint: str, key: str, at: str, days: int, late: str = "1 day",
):
    """The same against a log that grows while the job runs: an interval join of two streams, kept where nothing matched.

    `log` is a stream of successes with `key` and `at`. Rows of both sides may arrive `late` out of order; a row is
    written when no success that could suppress it can arrive any more, and both states are dropped behind the watermark.
    The newest rows thus wait for later ones on both sides. Rows without a key are never suppressed.
    """
    asked = stream.withWatermark(at, late)
    done = log.select(F.col(key).alias("_key"), F.col(at).alias("_done")).withWatermark("_done", late)
    # As `success_days`: at most `days` days before, and not at the same moment on the same day.
    near = (F.col("_done") >= F.col(at) - F.expr(f"INTERVAL {days} DAYS")) & (F.col("_done") < F.col(at))
    joined = asked.join(done, (F.col(key) == F.col("_key")) & near, "left_outer")
    return append_table(joined.where("_done is null").select(*stream.columns), path, checkpoint)


def notice_id(issue_key: Column, items: Column, failures: Column, rest: dict[str, Column] | None = None) -> Column:
    """Identity of a notice by meaning: order, repeats and times do not matter."""
    from curator.functions.ids import canonical_hash

    clean = lambda a: F.array_sort(F.array_distinct(a))
    return canonical_hash({"issue_key": issue_key, "items": clean(items), "failures": clean(failures), **(rest or {})})


def stream_notices(stream: DataFrame, path: str, checkpoint: str, at: str | None = None, remember: str = "30 days"):
    """Change notices that say something new. stream: issue_key, items[], failures[].

    With an event time `at`, a notice is remembered for `remember` after it, so the state is bounded and an equal notice
    may be sent again later. Without one every notice is remembered for good, which suits a replay of a closed log.
    """
    named = stream.withColumn("notice_id", notice_id(F.col("issue_key"), F.col("items"), F.col("failures")))
    if at is None:
        new = named.dropDuplicates(["notice_id"])
    else:
        new = named.withWatermark(at, remember).dropDuplicatesWithinWatermark(["notice_id"])
    return append_table(new.select("notice_id", "issue_key"), path, checkpoint)
