"""Keyed state with timers and an end: claims, progress, stuck reviews, and messages put in order.

These run on transformWithState, which needs the RocksDB state store; the session is to be set to it, and is not changed here.
Their timers and ends go by the clock, so batches follow each other without new rows, and a query runs until it is stopped:
give it a processing-time trigger, not availableNow. After a restart they go on with the first batch that brings rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def milliseconds(span: str) -> int:
    return int(pd.Timedelta(span).total_seconds() * 1000)


def transformed(df: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    provider = df.sparkSession.conf.get(PROVIDER, "")
    if not provider.endswith(("RocksDBStateStoreProvider",)):
        raise ValueError(f"{PROVIDER} has to be {ROCKSDB}")
    return df.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "ProcessingTime")


def claims(requests: DataFrame, *, keep: str = "30 days") -> DataFrame:
    """A stream of requests(repo_full_name, pr_number, head_sha, seq): the first of each key is claimed.

    A row that has a status, where requests carry one, tells how the key's review stands and is no request itself: a
    failed or pending review may be claimed again, a running or completed one may not. A key that nothing comes for is
    forgotten after `keep`; whoever asks later is told by the stored review, as claim_reviews does.
    """
    keys, span = ["repo_full_name", "pr_number", "head_sha"], milliseconds(keep)

    class Claims(StatefulProcessor):
        def init(self, handle) -> None:
            self.taken = handle.getValueState("taken", "taken boolean", span)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            taken = self.taken.exists() and bool(self.taken.get()[0])
            out = []
            batch = pd.concat(list(rows)).sort_values("seq")
            for seq, status in zip(batch["seq"], batch["status"], strict=True):
                if isinstance(status, str):
                    taken = status not in ("failed", "pending")
                    continue
                out.append((*key, seq, not taken))
                taken = True
            self.taken.update((taken,))
            yield pd.DataFrame(out, columns=[*keys, "seq", "claimed"])

        def close(self) -> None:
            pass

    if "status" not in requests.columns:
        requests = requests.withColumn("status", F.lit(None).cast("string"))
    return transformed(requests, keys, Claims(), "repo_full_name string, pr_number int, head_sha string, seq long, claimed boolean")


def progress(updates: DataFrame, *, keep: str = "1 day") -> DataFrame:
    """A stream of updates(review_id, seq, status, progress): those that change a review's state, until it ends.

    A review is forgotten when nothing was heard of it for `keep`.
    """
    span = milliseconds(keep)

    class Changes(StatefulProcessor):
        def init(self, handle) -> None:
            self.state = handle.getValueState("state", "last string, over boolean", span)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            last, over = self.state.get() if self.state.exists() else ("", False)
            out = []
            text = lambda x: x if isinstance(x, str) else ""
            for row in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
                now = f"{text(row.status)}:{text(row.progress)}"
                if over or now == last:
                    continue
                over, last = row.status in ("completed", "failed"), now
                out.append((key[0], row.seq, row.status, row.progress, over))
            self.state.update((last, over))
            yield pd.DataFrame(out, columns=["review_id", "seq", "status", "progress", "done"])

        def close(self) -> None:
            pass

    return transformed(updates, ["review_id"], Changes(), "review_id long, seq long, status string, progress string, done boolean")


def stuck(updates: DataFrame, *, idle: str = "10 minutes", most: int = 3) -> DataFrame:
    """A stream of updates(review_id, status): what becomes of each running review that no update reaches for that long.

    Every update of a running review starts its timer anew, an end removes it. A review whose timer fires goes back to
    pending, with one attempt more; after `most` attempts it fails instead and is forgotten. Out come review_id,
    attempts, status and error.
    """
    span = milliseconds(idle)
    columns = ["review_id", "attempts", "status", "error"]

    class Watch(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.attempts = handle.getValueState("attempts", "attempts int")
            self.timer = handle.getValueState("timer", "at long")

        def start(self, now: int) -> None:
            self.stop()
            self.handle.registerTimer(now + span)
            self.timer.update((now + span,))

        def stop(self) -> None:
            if self.timer.exists():
                self.handle.deleteTimer(self.timer.get()[0])
                self.timer.clear()

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            statuses = pd.concat(list(rows))["status"]
            if statuses.isin(["completed", "failed"]).any():
                self.stop()
                self.attempts.clear()
            else:
                if not self.attempts.exists():
                    self.attempts.update((0,))
                self.start(timerValues.getCurrentProcessingTimeInMs())
            yield pd.DataFrame([], columns=columns)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.timer.clear()
            attempts = self.attempts.get()[0] if self.attempts.exists() else 0
            if attempts >= most:
                self.attempts.clear()
                yield pd.DataFrame([(key[0], attempts, "failed", f"Timed out after {most} attempts")], columns=columns)
            else:
                self.attempts.update((attempts + 1,))
                self.start(timerValues.getCurrentProcessingTimeInMs())
                yield pd.DataFrame([(key[0], attempts + 1, "pending", None)], columns=columns)

        def close(self) -> None:
            pass

    return transformed(updates, ["review_id"], Watch(), "review_id long, attempts int, status string, error string")


def in_order(messages: DataFrame, *, wait: str = "1 minute", first: int = 1) -> DataFrame:
    """A stream of messages(key, seq, value) with place: each key's messages one behind the other, however batches bring them.

    seq numbers a key's messages from `first` on without gaps. What comes before its turn is held in a list, a row a
    message, until the ones before it are there. If they don't come for `wait`, the gap is passed: what is held goes out
    in order. A message whose turn has been passed goes out at once, with late set; one that was out already is dropped.
    place counts a key's messages as they go out; keys run beside each other.
    """
    span = milliseconds(wait)
    columns = ["key", "seq", "value", "place", "late"]

    class Order(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.next = handle.getValueState("next", "seq long, place long")
            self.held = handle.getListState("held", "seq long, value string")
            self.passed = handle.getListState("passed", "low long, high long")  # what the gaps that were passed left out
            self.timer = handle.getValueState("timer", "at long")

        def restart(self, now: int, waiting: bool) -> None:
            if self.timer.exists():
                if waiting:
                    return  # the gap is as old as its timer
                self.handle.deleteTimer(self.timer.get()[0])
                self.timer.clear()
            if waiting:
                self.handle.registerTimer(now + span)
                self.timer.update((now + span,))

        def state(self) -> tuple[int, int]:
            return tuple(self.next.get()) if self.next.exists() else (first, 1)

        def lists(self) -> tuple[dict, list]:
            return (dict(self.held.get()) if self.held.exists() else {}), (list(self.passed.get()) if self.passed.exists() else [])

        def store(self, held: dict, passed: list, seq: int, place: int) -> None:
            self.next.update((seq, place))
            for state, rows in ((self.held, sorted(held.items())), (self.passed, passed)):
                if rows:
                    state.put(rows)
                elif state.exists():
                    state.clear()

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            seq, place = self.state()
            held, passed = self.lists()
            before = seq
            out = []
            for s, v in pd.concat(list(rows)).sort_values("seq", kind="stable")[["seq", "value"]].itertuples(index=False):
                s, v = int(s), v if isinstance(v, str) else None
                if s >= seq:
                    held.setdefault(s, v)
                elif gap := next((g for g in passed if g[0] <= s <= g[1]), None):
                    passed.remove(gap)
                    passed += [g for g in ((gap[0], s - 1), (s + 1, gap[1])) if g[0] <= g[1]]
                    out.append((key[0], s, v, place, True))
                    place += 1
            while seq in held:
                out.append((key[0], seq, held.pop(seq), place, False))
                seq, place = seq + 1, place + 1
            self.store(held, passed, seq, place)
            if seq != before:
                self.restart(0, False)  # another gap now, if any
            self.restart(timerValues.getCurrentProcessingTimeInMs(), bool(held))
            yield pd.DataFrame(out, columns=columns)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.timer.clear()
            seq, place = self.state()
            held, passed = self.lists()
            out = []
            for s in sorted(held):
                if seq < s:
                    passed.append((seq, s - 1))
                out.append((key[0], s, held[s], place, False))
                seq, place = s + 1, place + 1
            self.store({}, passed, seq, place)
            yield pd.DataFrame(out, columns=columns)

        def close(self) -> None:
            pass

    return transformed(messages.select("key", "seq", "value"), ["key"], Order(), "key string, seq long, value string, place long, late boolean")
