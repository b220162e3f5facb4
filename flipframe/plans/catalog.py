"""Importing this module registers every query of the catalogue."""

from flipframe.plans import catalog_io, catalog_learn, catalog_metrics  # noqa: F401
