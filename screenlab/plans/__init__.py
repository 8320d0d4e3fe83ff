"""Queries over the driver tables."""

from functools import reduce

from . import duals, evaluation, external, further, models, patients, relations, screening, searches, selection

_PARTS = (relations, screening, evaluation, external, further, selection, patients, models, duals, searches, external)
QUERIES = reduce(dict.__or__, [p.QUERIES for p in _PARTS])
ORACLE_SQL = reduce(dict.__or__, [p.ORACLE_SQL for p in _PARTS])
