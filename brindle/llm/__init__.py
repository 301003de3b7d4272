"""Operators of a training-data pipeline: archives, packing, scoring, search, mixing, counting and near duplicates."""
