"""Operators on ordered sequences: DataFrames with a dense position column `pos` from 0 and a `value`."""
