"""DuckDB SQL that states independently what each registered query must return."""

from oracle.queries import oracle_sql

__all__ = ["oracle_sql"]
