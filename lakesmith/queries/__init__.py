"""The registered queries: every operator over the test tables, with its check in SQL."""

from . import columns, control, lake, tables

REGISTERED = {**tables.QUERIES, **columns.QUERIES, **control.QUERIES, **lake.QUERIES}
