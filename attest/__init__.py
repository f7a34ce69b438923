"""Registries of signed publications as Spark tables: admission, lists, sync, trust and reports."""
