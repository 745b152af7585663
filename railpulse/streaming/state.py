"""Keyed client state in Structured Streaming (T8, T9; stream form of C15/C16).

Per train key the state holds the current trajectory.  Each micro-batch
delivers the key's new observations (sorted by poll here, since order
inside a micro-batch is not guaranteed) and the same rule as in the batch fold
applies (``operators.reconciliation``).

Time is poll time.  The watermark follows the newest poll; a key that no poll of
the last ``ttl`` has shown is removed by an event-time timer, at the first poll that comes
``ttl`` or more after its last sighting, and the removal is emitted as a row
with ``removed = true``.  A key that comes back is new if the poll before (``prev_ms``,
``trajectory.previous_polls`` or whatever wrote the snapshots) was so late already, also when
both polls lie in one micro-batch and no timer could fire between them.

This is the one place with Python in a stream: the transition is a
per-key state machine, run through ``applyInPandasWithState`` (Arrow
batches per key group), never a row-at-a-time UDF.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from railpulse.functions.constants import TRAIN_RETENTION_S
from railpulse.operators.reconciliation import FIELDS, transition

STATE_SCHEMA = ("from_lat double, from_lng double, to_lat double, to_lng double, eta_s double, "
                "data_ts_ms long, pred_lat double, pred_lng double, pred_tt double, "
                "station_name string, last_seen_ms long, reanchors int")
OUTPUT_SCHEMA = ("set_number string, line_code string, " + STATE_SCHEMA
                 + ", n_obs long, removed boolean")


def _reconcile_group(key, pdfs: Iterator[pd.DataFrame], state: GroupState
                     ) -> Iterator[pd.DataFrame]:
    set_number, line_code = key
    if state.hasTimedOut:
        st = dict(zip(FIELDS, state.get))
        state.remove()
        yield pd.DataFrame([{"set_number": set_number, "line_code": line_code, **st,
                             "n_obs": 0, "removed": True}])
        return
    st = dict(zip(FIELDS, state.get)) if state.exists else None
    pdf = pd.concat(list(pdfs), ignore_index=True).sort_values("now_ms", kind="stable")
    n = 0
    for o in pdf.to_dict("records"):
        if st is not None and o["now_ms"] <= st["last_seen_ms"]:
            continue  # an older poll than the one already shown
        st = transition(st, o)
        n += 1
    if not n:
        return
    state.update(tuple(st[f] for f in FIELDS))
    # timers fire once the watermark is beyond them: at the first poll ttl or more after the last
    state.setTimeoutTimestamp(max(st["last_seen_ms"] + TRAIN_RETENTION_S * 1000 - 1,
                                  state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame([{"set_number": set_number, "line_code": line_code, **st, "n_obs": n,
                         "removed": False}])


def reconcile_stream(obs: DataFrame) -> DataFrame:
    """Streaming C15/C16 over observation rows (schema of ``trajectory.observations``) with ``prev_ms``."""
    cols = ["set_number", "line_code", "station_name", "from_lat", "from_lng", "to_lat",
            "to_lng", "eta_s", "data_ts_ms", "pred_lat", "pred_lng", "pred_tt", "now_ms", "prev_ms"]
    o = obs.select(*cols)
    for c in ("from_lat", "from_lng", "to_lat", "to_lng", "eta_s", "pred_lat", "pred_lng",
              "pred_tt"):
        o = o.withColumn(c, o[c].cast("double"))
    o = o.withColumn("poll", F.timestamp_millis("now_ms")).withWatermark("poll", "0 seconds")
    return o.groupBy("set_number", "line_code").applyInPandasWithState(
        _reconcile_group, OUTPUT_SCHEMA, STATE_SCHEMA, "update",
        GroupStateTimeout.EventTimeTimeout)
