"""Sources and sinks: test tables, mixed-layout CSV uploads, Parquet sinks."""
