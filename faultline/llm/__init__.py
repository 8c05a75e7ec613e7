"""Operators for preparing training corpora: sources, filters, deduplication, mixing, packing, output."""
