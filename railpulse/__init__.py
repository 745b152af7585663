"""railpulse — Spark-native analytics for live vehicle telemetry.

Every job is a ``DataFrame -> DataFrame`` function built from Spark SQL
built-ins (joins, windows, aggregates, higher-order functions) so Catalyst
plans it and Tungsten executes it.  Python only appears in the streaming
state processor, where the rule is a genuine per-key state machine.
"""

from railpulse.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
