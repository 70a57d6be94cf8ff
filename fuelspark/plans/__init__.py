"""Bindings to the driver tables, the query catalogue and the end-to-end run."""
