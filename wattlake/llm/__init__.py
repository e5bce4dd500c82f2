"""Operators of a training-data pipeline: language ID, mixing, deduplication, packing, quality and licence scans."""
