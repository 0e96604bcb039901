"""A PySpark-native engine for grouped-sample evaluation and training-text preparation."""
