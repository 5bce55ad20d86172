"""Queries over the tables, by area; importing this package registers all of them."""

from . import fusion, images, joins, language, metrics, models, preparation, profiles, records, routing, sequences, streams, structure  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
