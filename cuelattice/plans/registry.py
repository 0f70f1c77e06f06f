"""Every registered query of the transcript and catalogue operators, with its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuelattice.plans import q_align, q_captions, q_docs, q_files, q_jobs, q_tracks

_MODULES = (q_captions, q_files, q_align, q_docs, q_tracks, q_jobs)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: q for m in _MODULES for k, q in m.ORACLE_SQL.items()}
