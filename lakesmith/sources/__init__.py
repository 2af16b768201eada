"""Readers: tables, table logs, object listings, control tables, snapshots, run exports."""
