"""Telemetry analytics on Spark: sources, operators, plans, streaming twins and sinks."""
