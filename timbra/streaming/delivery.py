"""Alerts to channels: every channel for itself, so that one that fails holds up no other."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENT = "session_id string, at long, channel string, delivered boolean, status int, reason string"
#: What a channel does with an alert's JSON: its status, or an exception.
Channel = Callable[[str], int]


@dataclass(frozen=True)
class Webhook:
    """Posts the alert to a URL."""

    url: str
    timeout: float = 4.0

    def __call__(self, payload: str) -> int:
        if not self.url:
            raise ValueError("no webhook URL configured")
        request = urllib.request.Request(self.url, payload.encode(), {"Content-Type": "application/json"})  # noqa: S310
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:  # noqa: S310
                return answer.status
        except urllib.error.HTTPError as e:
            return e.code


def console(payload: str) -> int:
    """A line on the worker's output."""
    alert = json.loads(payload)
    print(f"[{alert.get('band')}] {alert.get('session_id')}: {alert.get('headline')}", flush=True)
    return 200


class Channels(dict):
    """Channels by name; there is always a console."""

    def __init__(self, **channels: Channel):
        super().__init__(console=console, **channels)

    def register(self, name: str, channel: Channel) -> Channels:
        return Channels(**{**{k: v for k, v in self.items() if k != "console"}, name: channel})


def delivered(alerts: DataFrame, channels: Channels, wanted: str | None = None) -> DataFrame:
    """A row for each alert (session_id, at, payload) and channel: delivered, status, reason. The
    column ``wanted`` lists an alert's channels (null, or none of the registered: the console).
    An alert whose job is tried again may be sent again; receivers know it by session and time."""
    names = list(channels)
    own = F.array_intersect(F.coalesce(F.col(wanted), F.array().cast("array<string>")), F.array(*map(F.lit, names))) if wanted else F.array(F.lit("console"))
    rows = alerts.select(F.col("session_id").cast("string"), F.col("at").cast("long"), "payload", F.explode(F.when(F.size(own) > 0, own).otherwise(F.array(F.lit("console")))).alias("channel"))

    def one(name: str, payload: str) -> tuple[bool, int | None, str | None]:
        try:
            status = channels[name](payload)
        except Exception as e:  # noqa: BLE001  a channel that fails is told, not raised
            return False, None, str(e)
        return status < 400, status, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            told = [one(c, p) for c, p in zip(pdf["channel"], pdf["payload"], strict=True)]
            out = pdf[["session_id", "at", "channel"]].copy()
            out["delivered"] = [t[0] for t in told]
            out["status"] = pd.array([t[1] for t in told], "Int32")
            out["reason"] = [t[2] for t in told]
            yield out

    return rows.mapInPandas(run, SENT)
