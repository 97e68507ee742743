"""Operators over fact relations: DataFrames in, DataFrames out."""
