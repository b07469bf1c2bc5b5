"""Bindings of tables to records, and named queries."""
