"""The row-wise operators and keep-first deduplication on streams."""
