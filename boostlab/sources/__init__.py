"""Generators, text scans, result documents and dataset hand-over."""
