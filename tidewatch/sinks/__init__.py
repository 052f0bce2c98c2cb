"""Sinks: tables by micro-batch (replaced when a batch is run again), appending tables, Kafka, dead letters."""
