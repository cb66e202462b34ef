"""A PySpark-native text-analytics engine: text to model-ready batches and back, at cluster scale."""
