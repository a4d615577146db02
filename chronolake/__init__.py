"""A PySpark-native engine for version-history data kept as a lake of Parquet tables."""
