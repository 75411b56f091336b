"""Streaming extensions: the catalogue's batch rules on unbounded input.

The tap counter and the rate windows are event-time aggregates with a watermark; the alert latch
keeps each alert's state across batches of prices; offers run out by timers; reads that arrive page by page are held until they
are whole or overdue; the feed loop applies a batch function to each micro-batch of a shop's read.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tap_counts(taps: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Taps per shop, channel and window; later ones than the watermark are dropped."""
    out = taps.withWatermark("created_at", late).groupBy("store_id", "channel", F.window("created_at", window).alias("w")).agg(F.count("*").alias("taps"))
    return out.select("store_id", "channel", F.col("w.start").alias("window_start"), "taps")


def rolling(taps: DataFrame, days: int, late: str = "2 days") -> DataFrame:
    """Taps of each shop in the ``days`` days up to and with each day that has one, given out once the watermark has passed."""
    window = F.window("created_at", f"{max(1, min(days, 365))} days", "1 day")
    out = taps.withWatermark("created_at", late).groupBy("store_id", window.alias("w")).agg(F.count("*").alias("taps"))
    return out.select("store_id", F.date_sub(F.to_date("w.end"), 1).alias("day"), "taps")


def over_rate(requests: DataFrame, key: str, ts: str, window: str, most: int, late: str = "1 minute") -> DataFrame:
    """Fixed windows in which a key made more requests than allowed."""
    out = requests.withWatermark(ts, late).groupBy(key, F.window(ts, window).alias("w")).agg(F.count("*").alias("requests"))
    return out.filter(F.col("requests") > most).select(key, F.col("w.start").alias("window_start"), "requests")


def alert_events(prices: DataFrame) -> DataFrame:
    """notify and reset events of alerts, from a stream of (alert_id, target, total, at): one
    notification per fall to the target, and a reset when the price is above it again.  Prices count
    in the order of their times; one that comes after a later price of its alert has been seen tells
    of a state that is past, and is ignored."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        told, seen = (bool(state.get[0]), state.get[1]) if state.exists else (False, None)
        rows = pd.concat(list(batches)).sort_values("at")
        rows = rows if seen is None else rows[rows["at"] > pd.Timestamp(seen)]
        events = []
        for target, total, at in zip(rows["target"], rows["total"], rows["at"]):
            if total <= target and not told:
                told = True
                events.append((key[0], "notify", at))
            elif total > target and told:
                told = False
                events.append((key[0], "reset", at))
        state.update((told, rows["at"].iloc[-1].to_pydatetime() if len(rows) else seen))
        yield pd.DataFrame(events, columns=["alert_id", "event", "at"])

    return prices.groupBy("alert_id").applyInPandasWithState(step, "alert_id bigint, event string, at timestamp", "told boolean, seen timestamp", "append", GroupStateTimeout.NoTimeout)


def offer_events(readings: DataFrame, keep: dt.timedelta = dt.timedelta(hours=48), late: str = "1 hour") -> DataFrame:
    """``offers.expiries`` on a stream of readings (``alias_id, checked_at``), in any order within ``late``.
    A reading counts once the watermark has passed it, and an offer is gone once the watermark has passed its
    end: a timer of its own wakes each listing then, so nothing is scanned.  State is one listing's last
    counted reading, whether it ran out, and the readings that the watermark has not passed."""
    span = int(keep.total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, gone, waiting = state.get if state.exists else (None, False, [])
        passed = state.getCurrentWatermarkMs()
        new = [] if state.hasTimedOut else [int(t.timestamp() * 1000) for rows in batches for t in rows["checked_at"] if not pd.isna(t)]
        waiting, events = sorted({*waiting, *new}), []
        while waiting and waiting[0] <= passed:
            at = waiting.pop(0)
            if last is None or at > last + span:
                if last is not None and not gone:
                    events.append((key[0], "gone", last + span))
                events.append((key[0], "new" if last is None else "back", at))
            last, gone = at if last is None else max(last, at), False
        if last is not None and not gone and last + span < passed:
            events.append((key[0], "gone", last + span))
            gone = True
        state.update((last, gone, waiting))
        due = ([waiting[0]] if waiting else []) + ([last + span] if last is not None and not gone else [])
        if due:
            state.setTimeoutTimestamp(max(min(due), passed) + 1)
        yield pd.DataFrame([(a, e, pd.Timestamp(at, unit="ms")) for a, e, at in events], columns=["alias_id", "event", "at"])

    known = readings.withWatermark("checked_at", late).groupBy("alias_id")
    return known.applyInPandasWithState(step, "alias_id bigint, event string, at timestamp", "last long, gone boolean, waiting array<long>", "append", GroupStateTimeout.EventTimeTimeout)


READ = "store string, target string, read_id string, page int, status_code int, text string, complete boolean"


def whole_reads(pages: DataFrame, patience: str = "1 hour") -> DataFrame:
    """Reads that arrive page by page (``store, target, read_id, page, status_code, text, at``), in any
    order and over any batches, given out whole: as complete once the pages from 1 to the one without
    products are all there with status 200, or as incomplete (``complete`` false: it must not delist)
    when nothing has come for ``patience``.  Of a page that comes twice the first counts; what comes
    after a read was given out is dropped until its patience is over.  State holds one read's pages."""
    names = [c.split()[0] for c in READ.split(", ")]

    def ends(code: int | None, text: str | None) -> bool:
        try:
            found = json.loads(text or "")
        except ValueError:
            return False
        return code == 200 and isinstance(found, dict) and found.get("products") == []

    def given(key: tuple, held: dict, complete: bool) -> pd.DataFrame:
        return pd.DataFrame([(*key, p, *held[p], complete) for p in sorted(held)], columns=names)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        numbers, codes, texts, last, done = state.get if state.exists else ([], [], [], None, False)
        held = {p: (c, t) for p, c, t in zip(numbers, codes, texts)}
        if state.hasTimedOut:
            state.remove()
            yield given(key, held, False)
            return
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        last = max([int(rows["at"].max().timestamp() * 1000), *([last] if last is not None else [])])
        for p, c, t in zip(rows["page"], rows["status_code"], rows["text"]):
            held.setdefault(int(p), (None if pd.isna(c) else int(c), None if pd.isna(t) else str(t)))
        end = min((p for p, (c, t) in held.items() if ends(c, t)), default=0)
        whole = not done and end > 0 and all(p in held and held[p][0] == 200 for p in range(1, end + 1))
        if whole:
            yield given(key, held, True)
        done = done or whole
        kept = {} if done else held
        state.update((sorted(kept), [kept[p][0] for p in sorted(kept)], [kept[p][1] for p in sorted(kept)], last, done))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 1)

    kind = "pages array<int>, codes array<int>, texts array<string>, last long, done boolean"
    # The watermark is behind by the patience: it passes a read's last page when nothing has come for that long.
    return pages.withWatermark("at", patience).groupBy("store", "target", "read_id").applyInPandasWithState(step, READ, kind, "append", GroupStateTimeout.EventTimeTimeout)


def each_read(pages: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run ``apply`` on each micro-batch of landed pages; what is available now, then stop."""
    return pages.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
