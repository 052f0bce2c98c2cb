"""Adapters from wire formats and tables to the canonical event, and seeded generators."""
