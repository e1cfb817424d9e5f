"""Readers and writers: JSON-lines datasets, run logs, manifests, audio, benchmark results, demo data."""
