"""Relational and corpus operators over DataFrames."""
