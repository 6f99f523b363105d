"""Event-session analytics on Spark: scans, joins, block statistics, inference."""
