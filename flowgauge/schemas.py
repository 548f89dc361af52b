"""Explicit schemas of the data model. Times are epoch seconds unless typed as timestamp."""

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    names = {
        "string": T.StringType(),
        "int": T.IntegerType(),
        "bigint": T.LongType(),
        "double": T.DoubleType(),
        "timestamp": T.TimestampType(),
        "timestamp_ntz": T.TimestampNTZType(),
        "labels": T.MapType(T.StringType(), T.StringType()),
    }
    fields = [part.split() for part in spec.split(",")]
    return T.StructType([T.StructField(name, names[kind]) for name, kind in fields])


EXECUTOR_STATS = _struct(
    "topology_id string, tick bigint, component_id string, component_type string,"
    "executor_id bigint, num_executors int, num_tasks int, uptime_secs int,"
    "emitted bigint, transferred bigint, acked bigint, failed bigint, executed bigint,"
    "complete_latency_ms double, process_latency_ms double, execute_latency_ms double,"
    "capacity double"
)
#: The same per stream of an executor, as a runtime counts them.
STREAM_STATS = T.StructType(EXECUTOR_STATS.fields + [T.StructField("stream_id", T.StringType())])
EDGES = _struct("topology_id string, edge_no bigint, src string, dst string")
TARGETS = _struct("topology_id string, component_id string, target_rate double")
SAMPLES = _struct("metric string, labels labels, ts timestamp, value double")
READINGS = _struct(
    "id bigint, ts_s bigint, value double, property int, plug_id int, household_id int, house_id int"
)
EVENTS = _struct(
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)
