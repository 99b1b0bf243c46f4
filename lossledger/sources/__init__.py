"""Sources: the driver's parquet tables mapped onto the raw claims tables,
plus the literal reference tables."""
