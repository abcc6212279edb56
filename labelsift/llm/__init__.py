"""Operators for preparing training text: packing, de-duplication, mixing, privacy, fingerprints, quality."""
