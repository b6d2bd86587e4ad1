"""Operators for preparing training data: formatting, scans, deduplication, mixing, packing, classification."""
