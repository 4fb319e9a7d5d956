"""All registered queries of the library."""

from __future__ import annotations

from . import documents, games, guidance, history, joins, layout, mainpath, pages, profiles, results, review, scalars, sequences, stories, structures, titles, trees  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
