"""granary: a PySpark-native analytics engine for retail lakehouses and, in `llm`, training-data pipelines."""
