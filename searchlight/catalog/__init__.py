"""All queries of the library but the training-data ones: name -> query, and name -> SQL with the same answer.

The last digits of a floating-point sum depend on the order of its terms. So both sides round such columns,
which ``rounding.FLOATS`` names, to six places.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from searchlight.catalog import exports, intents, page_checks, page_tree, pages, pairs, periods, planning, search, sources, verdicts, weblog
from searchlight.catalog.rounding import FLOATS

_PARTS = (weblog, search, pairs, periods, pages, sources, intents, page_checks, page_tree, planning, exports, verdicts)
PLACES = 6


def _rounded(name: str, run):
    if name not in FLOATS:
        return run
    return lambda spark, sf_dir: run(spark, sf_dir).withColumns({c: F.round(c, PLACES) for c in FLOATS[name]})


def _rounded_sql(name: str, sql: str) -> str:
    if name not in FLOATS:
        return sql
    return f"SELECT * REPLACE ({', '.join(f'round("{c}", {PLACES}) AS "{c}"' for c in FLOATS[name])}) FROM ({sql}) AS answer"


QUERIES = {name: _rounded(name, run) for part in _PARTS for name, run in part.QUERIES.items()}
ORACLE_SQL = {name: _rounded_sql(name, sql) for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
