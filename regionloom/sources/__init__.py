"""Text and Parquet sources and sinks with stated schemas."""
