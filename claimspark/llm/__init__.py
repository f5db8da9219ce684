"""Operators for large text corpora: scans, filters, deduplication, decontamination and packing.

Nothing outside this folder imports it. Each operator module has a general function; `queries` applies them to the tables.
"""
