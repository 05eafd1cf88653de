"""solvegrid: a PySpark-native engine for solve-matrix analytics."""
