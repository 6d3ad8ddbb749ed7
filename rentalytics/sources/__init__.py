"""Sources and sinks: raw text tables, parquet tables, JSON lookups, artefacts."""
