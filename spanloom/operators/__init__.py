"""DataFrame-in, DataFrame-out operators over the telemetry tables."""
