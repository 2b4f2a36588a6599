"""Whole jobs, records and exports."""
