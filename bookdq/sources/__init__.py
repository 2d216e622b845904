"""Where books and reference lists come from, and where results go."""
from bookdq.sources.readers import Sources, read_source
from bookdq.sources.sinks import FindingsStore, export_table, load_to_table, write_extract

__all__ = ["FindingsStore", "Sources", "export_table", "load_to_table", "read_source", "write_extract"]
