"""Continuous forms: a watched project, edge counts that are kept up, sequences of events."""
