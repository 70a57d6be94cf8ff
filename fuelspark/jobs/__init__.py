"""Whole runs: a store of versioned tables, the station run and the daily price run."""
