"""Column functions: normalisation, metrics, flags, formatting."""
