"""Tidegrid: a PySpark-native analytics engine for load time series and training corpora."""
