"""Demand, waste and forecast analytics for food-service data, on Spark DataFrames."""

__all__ = ["operators", "sources", "functions", "plans", "streaming"]
