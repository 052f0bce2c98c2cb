"""Registered queries over the Parquet tables, with the DuckDB SQL they are checked against."""
