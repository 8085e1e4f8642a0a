"""Operators of a training-data pipeline; nothing outside this package needs it."""
