"""Disruption-risk analytics on Spark: events, ports, weeks, features, models and risk cards as DataFrame jobs."""
