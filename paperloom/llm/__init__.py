"""Operators of a training-data pipeline. Nothing else in paperloom imports this subpackage."""
