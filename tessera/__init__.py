"""Event studies over time-series panels, and corpus operators, on Spark."""
