"""All queries over the driver tables."""

from __future__ import annotations

from . import classification, curation, evaluation, generated, latent, robust, round_trips, statistics, structure, texts
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "classification", "curation", "evaluation", "generated", "latent", "robust", "round_trips", "statistics", "structure", "texts"]
