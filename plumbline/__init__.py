"""Plumbline: evaluation, calibration and corpus analytics on Spark DataFrames."""
