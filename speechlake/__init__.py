"""speechlake: a PySpark-native engine for the data side of synthetic-voice detection."""
