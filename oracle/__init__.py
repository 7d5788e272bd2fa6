"""DuckDB statements the registered queries are compared with."""

from oracle import documents, eventlog, grading, panel, quality, realised, returns, universe

ORACLE_SQL: dict[str, str] = {**panel.SQL, **universe.SQL, **eventlog.SQL, **quality.SQL, **returns.SQL, **grading.SQL, **realised.SQL, **documents.SQL}
