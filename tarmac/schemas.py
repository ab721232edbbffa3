"""Schemas of the records, as Spark DDL. Times are epoch milliseconds."""

PING = "vehicle_id string, event_id string, timestamp_ms long, lat double, lon double, speed_mps double"
METRIC = "segment_id string, window_start_ms long, window_end_ms long, ping_count long, avg_speed_mps double, min_speed_mps double, max_speed_mps double"
#: The wire form of a metric, whose count clashes with DataFrame methods.
METRIC_JSON = "segmentId string, windowStartMs long, windowEndMs long, count long, avgSpeedMps double, minSpeedMps double, maxSpeedMps double"
INCIDENT = "incident_id string, segment_id string, status string, start_ts long, end_ts long, severity double, baseline_speed_mps double, observed_speed_mps double, observed_count long"
HISTORY = INCIDENT + ", ingested_at timestamp"
HISTORY_KEY = ["incident_id", "status", "end_ts"]
CURRENT = "incident_id string, segment_id string, start_ts long, severity double, baseline_speed_mps double, observed_speed_mps double, observed_count long, updated_at timestamp"
#: (our column, wire field) of an incident event.
INCIDENT_JSON = [("incident_id", "incidentId"), ("segment_id", "segmentId"), ("status", "status"), ("start_ts", "startTs"), ("end_ts", "endTs"), ("severity", "severity"), ("baseline_speed_mps", "baselineSpeedMps"), ("observed_speed_mps", "observedSpeedMps"), ("observed_count", "observedCount")]
