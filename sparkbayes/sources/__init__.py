"""Sources and sinks: Parquet scans, shuffled mini-batches, saved models."""
