"""Spark-native analytics for paired motion sequences: DataFrame operators, SQL expressions and Arrow kernels."""

__version__ = "0.1.0"
