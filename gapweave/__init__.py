"""Spark-native engine for sparse multi-sensor time-series panels: calibration, gap filling, anomalies, validation."""
