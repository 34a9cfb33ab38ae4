from riskframe.sources.tables import read_table, read_tables, nan_to_null_all

__all__ = ["read_table", "read_tables", "nan_to_null_all"]
