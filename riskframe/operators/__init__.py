"""Operators: DataFrame -> DataFrame functions parameterised by column names."""
