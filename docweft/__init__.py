"""A PySpark-native document-intelligence and evidence-graph engine."""
