"""Catalog and signal-window analytics as Spark DataFrame operators."""
