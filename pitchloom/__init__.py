"""Spark-native match forecasting, tournament analytics and table contracts."""
