"""Readers, zone tables and exports."""
