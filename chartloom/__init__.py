"""Chartloom: clinical-document analytics on Spark DataFrames."""
