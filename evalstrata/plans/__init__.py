"""Whole plans: run comparison, validation reports, training data, cards, and the driver's queries."""
