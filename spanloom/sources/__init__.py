"""Readers, writers and shaping of incoming telemetry."""
