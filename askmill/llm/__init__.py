"""Operators of a training-data pipeline: tokens, packing, duplicates, quality, safety, licences, shards."""
