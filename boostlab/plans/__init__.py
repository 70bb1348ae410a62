"""Whole dataflows: sweeps over configurations and comparison reports."""
