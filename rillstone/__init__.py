"""A PySpark-native engine for sensor time series, graphs and forecast evaluation."""
