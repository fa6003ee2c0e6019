"""strata: a PySpark-native, manifest-driven ingestion and data-quality engine."""
