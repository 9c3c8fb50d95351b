"""Spark-native analytics for particle-sensor records.

Every operator takes and returns DataFrames; the plan is left to Catalyst and AQE.
"""
