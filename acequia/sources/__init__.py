"""Readers and writers."""

from acequia.sources.fact import StoredFact, read_fact, read_fact_jdbc
from acequia.sources.tables import read_table, shared_folder, write_csv, write_table

__all__ = ["StoredFact", "read_fact", "read_fact_jdbc", "read_table", "shared_folder", "write_csv", "write_table"]
