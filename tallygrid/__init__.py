"""Tabular statistics as Spark jobs: tables in, tables out."""
