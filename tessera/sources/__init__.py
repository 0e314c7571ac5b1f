"""Sources and sinks: parquet tables, CSV/JSON/Excel file loading, exports."""
