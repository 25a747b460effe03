"""Curation of fleets of tabular machine-learning datasets as Spark jobs."""
from fleetsieve.fleet import Fleet

__all__ = ["Fleet"]
