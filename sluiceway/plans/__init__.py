"""Specs: language, types, analysis, blocks and the compiler to DataFrames."""
