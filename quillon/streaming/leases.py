"""Leases of a stream of requests: one state a resource, fencing tokens that only grow, expiry by timers.

Requests wait in the resource's state until the watermark has passed them and are then judged in order of their time and id. So the same requests give
the same decisions and the same state, in whatever order, batches or repetitions they came within the watermark's delay; later ones are
dropped by it. A lease that is not renewed ends by itself: the next request finds it gone, and a timer says so.

Defined cases: a repeated id counts once; a request without resource, id, holder or time is refused by ``valid``; an unknown action is denied; a lease of no
seconds or fewer ends at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

REQUEST = "id string, resource string, holder string, action string, token long, seconds long, at timestamp"
DECISION = "resource string, id string, holder string, action string, outcome string, token long, expires timestamp"
LEASE = "holder string, token long, expires long, held boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def decided(lease: tuple, request: tuple) -> tuple[tuple, str]:
    """(lease after, outcome) of a lease (holder, token, expires ms, held) and a request (at ms, id, holder, action, token, seconds)."""
    holder, last, expires, held = lease
    at, _, who, action, token, seconds = request
    held = held and expires > at
    until = at + 1000 * max(0, seconds or 0)
    if action == "acquire":
        if held and holder != who:
            return (holder, last, expires, held), "denied_held"
        if held:
            return (who, last, max(expires, until), True), "extended"
        return (who, last + 1, until, True), "granted"
    if action in ("renew", "release"):
        if not held:
            return (holder, last, expires, False), "denied_expired"
        if holder != who or token != last:
            return (holder, last, expires, held), "denied_fenced"
        return ((who, last, until, True), "renewed") if action == "renew" else ((who, last, at, False), "released")
    return (holder, last, expires, held), "denied_unknown"


class Leases(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", LEASE)
        self.waiting = handle.getMapState("waiting", "id string", "at long, holder string, action string, token long, seconds long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for r in pdf.itertuples():
                if not self.waiting.containsKey((r.id,)):
                    at = int(r.at.timestamp() * 1000)
                    self.waiting.updateValue((r.id,), (at, r.holder, r.action, None if pd.isna(r.token) else int(r.token), None if pd.isna(r.seconds) else int(r.seconds)))
                    self.handle.registerTimer(at)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((v[0], k[0], *v[1:]) for k, v in self.waiting.iterator() if v[0] <= now)
        lease = tuple(self.lease.get()) if self.lease.exists() else (None, 0, 0, False)
        out = []
        if lease[3] and lease[2] <= now and not (due and due[0][0] < lease[2]):
            out.append((key[0], None, lease[0], "expire", "expired", lease[1], lease[2]))
            lease = (lease[0], lease[1], lease[2], False)
        for request in due:
            lease, outcome = decided(lease, request)
            out.append((key[0], request[1], request[2], request[3], outcome, lease[1], lease[2]))
            if lease[3]:
                self.handle.registerTimer(lease[2])
        for request in due:
            self.waiting.removeKey((request[1],))
        self.lease.update(lease)
        pdf = pd.DataFrame(out, columns=["resource", "id", "holder", "action", "outcome", "token", "expires"])
        yield pdf.assign(expires=pd.to_datetime(pdf["expires"], unit="ms"))

    def close(self) -> None:
        pass


def valid(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests that can be judged, the others)."""
    good = F.col("id").isNotNull() & F.col("resource").isNotNull() & F.col("holder").isNotNull() & F.col("at").isNotNull()
    return requests.filter(good), requests.filter(~good)


def leases(requests: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Decisions on a stream of valid requests, each once the watermark has passed it. Needs the RocksDB state store (``PROVIDER``)."""
    return requests.withWatermark("at", late).groupBy("resource").transformWithStateInPandas(
        statefulProcessor=Leases(), outputStructType=DECISION, outputMode="Append", timeMode="EventTime"
    )
