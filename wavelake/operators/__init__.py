"""Operators: DataFrame in, DataFrame out. A signal is (key columns, order column, value columns)."""
