"""One query per operator over views of the driver's tables, each with DuckDB SQL for the same rows."""

from . import graphs, parsing, samples, scores, terms
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "graphs", "parsing", "samples", "scores", "terms"]
