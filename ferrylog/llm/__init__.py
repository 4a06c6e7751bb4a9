"""Operators of a training-data pipeline: scoring, de-duplication, scanning, search, mixing and token ids."""
