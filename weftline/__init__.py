"""A PySpark-native engine that turns search results and raw pages into ranked, policy-checked, auditable text."""
