"""Queries over the star schema, events, documents, vectors and conversations."""

from . import aggregates, corpus, features, files, filters, guards, joins, ranking, standard, storage  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
