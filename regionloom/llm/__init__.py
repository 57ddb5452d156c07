"""Operators of a training-data pipeline: cleaning, de-duplication, scoring, mixing and sharding of documents."""
