"""The client's rule for one train and one poll (C15, T8), used by the batch fold and by the stream.

A state is a dict of ``FIELDS``; an observation has the trajectory fields of its poll,
``now_ms`` (the poll) and ``prev_ms`` (the poll before it, or None).  The client drops a
train that it finds absent when a poll comes ``ttl`` or more after the last sighting, so
a train is new again if the poll before this one was so late already; how long ago the
last sighting is now doesn't matter.
"""

from __future__ import annotations

from railpulse.functions.constants import (DEFAULT_TRAVEL_TIME_SECONDS,
                                           ETA_SHIFT_TOLERANCE_S, PLATFORM_DWELL_S,
                                           PREDICTED_DEPARTURE_CAP, TRAIN_RETENTION_S)

FIELDS = ["from_lat", "from_lng", "to_lat", "to_lng", "eta_s", "data_ts_ms", "pred_lat", "pred_lng",
          "pred_tt", "station_name", "last_seen_ms", "reanchors"]


def absent(x) -> bool:
    return x is None or (isinstance(x, float) and x != x)


def dead_reckon(st: dict, now_ms: int) -> tuple[float, float]:
    """Position of a state at ``now_ms`` (same rule as the batch expression)."""
    eta = st["eta_s"]
    el = (now_ms - st["data_ts_ms"]) / 1000.0
    if not absent(st["to_lat"]) and not absent(st["to_lng"]) and not absent(eta) and eta > 0:
        f = min(1.0, max(0.0, el) / eta)
        return (st["from_lat"] + (st["to_lat"] - st["from_lat"]) * f,
                st["from_lng"] + (st["to_lng"] - st["from_lng"]) * f)
    if absent(eta) and not absent(st["pred_lat"]) and not absent(st["pred_lng"]) and \
            el > PLATFORM_DWELL_S:
        tt = DEFAULT_TRAVEL_TIME_SECONDS if absent(st["pred_tt"]) else st["pred_tt"]
        f = min(PREDICTED_DEPARTURE_CAP, (el - PLATFORM_DWELL_S) / tt)
        return (st["from_lat"] + (st["pred_lat"] - st["from_lat"]) * f,
                st["from_lng"] + (st["pred_lng"] - st["from_lng"]) * f)
    return st["from_lat"], st["from_lng"]


def replaces(last_ms: int, station: str | None, eta: float | None, o: dict,
             ttl_s: int = TRAIN_RETENTION_S) -> bool:
    """Whether an observation replaces a train last seen at ``last_ms`` with that station and ETA.

    The state's own ETA is missing exactly if that of the last observation is, so this
    needs the last observation only.
    """
    prev = o["prev_ms"]
    if not absent(prev) and prev - last_ms >= ttl_s * 1000:
        return True
    same = station == o["station_name"] or (absent(station) and absent(o["station_name"]))
    return not same or absent(eta) or absent(o["eta_s"])


def transition(st: dict | None, o: dict, ttl_s: int = TRAIN_RETENTION_S) -> dict:
    """One observation merged into the (possibly absent) state."""
    now_ms = int(o["now_ms"])
    if st is None or replaces(st["last_seen_ms"], st["station_name"], st["eta_s"], o, ttl_s):
        return {**{f: o[f] for f in FIELDS[:10]}, "last_seen_ms": now_ms, "reanchors": 0}
    old_eta = st["data_ts_ms"] + st["eta_s"] * 1000
    new_eta = o["data_ts_ms"] + o["eta_s"] * 1000
    nxt = {**st, "pred_lat": o["pred_lat"], "pred_lng": o["pred_lng"], "pred_tt": o["pred_tt"],
           "station_name": o["station_name"], "last_seen_ms": now_ms}
    if abs(new_eta - old_eta) < ETA_SHIFT_TOLERANCE_S * 1000:
        return nxt
    lat, lng = dead_reckon(st, now_ms)
    return {**nxt, "from_lat": lat, "from_lng": lng, "to_lat": o["to_lat"], "to_lng": o["to_lng"],
            "data_ts_ms": now_ms, "eta_s": max(0.0, (new_eta - now_ms) / 1000.0),
            "reanchors": st["reanchors"] + 1}
