"""Operators of a training-data pipeline: fingerprints, classifiers, near copies, archives, packing.

Nothing else in the library imports this package.
"""
