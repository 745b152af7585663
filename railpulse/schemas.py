"""Declared schemas of the data model (fixed, as in the reference)."""

from pyspark.sql import types as T

S = T.StringType()
D = T.DoubleType()

# Raw message envelope: one whole line snapshot per message.
RAW_MESSAGE = T.StructType([
    T.StructField("key", T.BinaryType()),
    T.StructField("value", T.BinaryType()),
    T.StructField("headers", T.ArrayType(T.StructType([
        T.StructField("key", S), T.StructField("value", T.BinaryType())]))),
    T.StructField("timestamp", T.TimestampType()),
])

# XML snapshot ROOT/S/P/T with attributes, as read by ``from_xml``
# (attribute prefix ``_``; every level may repeat).
_TRAIN = T.StructType([T.StructField(f"_{a}", S) for a in ("S", "T", "C", "DE", "L")])
_PLATFORM = T.StructType([T.StructField("_N", S), T.StructField("_Code", S),
                          T.StructField("T", T.ArrayType(_TRAIN))])
_STATION = T.StructType([T.StructField("_Code", S), T.StructField("_N", S),
                         T.StructField("P", T.ArrayType(_PLATFORM))])
SNAPSHOT_XML = T.StructType([T.StructField("S", T.ArrayType(_STATION))])

# Flat prediction row (nine string attributes + line code).
PREDICTION_FIELDS = ["station_code", "station_name", "platform_name", "platform_code",
                     "trip_number", "set_number", "time_to_station", "destination",
                     "current_location"]

# Fact table ``train_positions``.
TRAIN_POSITIONS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("set_number", S, False),
    T.StructField("trip_number", S),
    T.StructField("line_code", S),
    T.StructField("station_code", S),
    T.StructField("station_name", S),
    T.StructField("platform_name", S),
    T.StructField("platform_code", S),
    T.StructField("current_location", S),
    T.StructField("time_to_station", S),
    T.StructField("destination", S),
    T.StructField("calculated_lat", D),
    T.StructField("calculated_lng", D),
    T.StructField("heading", S),
    T.StructField("timestamp", T.TimestampNTZType()),
])

STATIONS = T.StructType([
    T.StructField("code", S, False), T.StructField("name", S, False),
    T.StructField("lat", D), T.StructField("lng", D),
    T.StructField("lines", T.ArrayType(S)),
])

LINES = T.StructType([T.StructField("code", S, False), T.StructField("name", S, False),
                      T.StructField("color", S, False)])

EDGES = T.StructType([
    T.StructField("line_code", S, False), T.StructField("from_code", S, False),
    T.StructField("to_code", S, False), T.StructField("sequence_order", T.IntegerType(), False),
    T.StructField("from_lat", D), T.StructField("from_lng", D),
    T.StructField("to_lat", D), T.StructField("to_lng", D),
    T.StructField("travel_time_seconds", T.IntegerType()),
])

# Stop-point JSON document (``stopPoints`` array).
STOP_POINT = T.StructType([
    T.StructField("naptanId", S), T.StructField("stationNaptan", S),
    T.StructField("commonName", S), T.StructField("lat", D), T.StructField("lon", D),
    T.StructField("modes", T.ArrayType(S)),
    T.StructField("lineModeGroups", T.ArrayType(T.StructType([
        T.StructField("modeName", S), T.StructField("lineIdentifier", T.ArrayType(S))]))),
    T.StructField("lines", T.ArrayType(T.StructType([T.StructField("id", S)]))),
])
STOP_POINTS_DOC = T.StructType([T.StructField("stopPoints", T.ArrayType(STOP_POINT))])

# Route-sequence JSON document.
ROUTE_STOP = T.StructType([T.StructField("stationId", S), T.StructField("id", S),
                           T.StructField("name", S), T.StructField("lat", D),
                           T.StructField("lon", D)])
ROUTE_DOC = T.StructType([
    T.StructField("lineId", S),
    T.StructField("orderedLineRoutes", T.ArrayType(T.StructType([T.StructField("name", S)]))),
    T.StructField("stopPointSequences", T.ArrayType(T.StructType([
        T.StructField("branchId", S), T.StructField("direction", S),
        T.StructField("stopPoint", T.ArrayType(ROUTE_STOP))]))),
])

# Timetable JSON document.
TIMETABLE_DOC = T.StructType([
    T.StructField("lineId", S),
    T.StructField("timetable", T.StructType([
        T.StructField("departureStopId", S),
        T.StructField("routes", T.ArrayType(T.StructType([
            T.StructField("stationIntervals", T.ArrayType(T.StructType([
                T.StructField("intervals", T.ArrayType(T.StructType([
                    T.StructField("stopId", S),
                    T.StructField("timeToArrival", D)])))])))])))])),
])
