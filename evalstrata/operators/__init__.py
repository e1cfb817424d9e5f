"""Operators on examples and runs: scoring, pairing, slices, validation, alignment, audio."""
