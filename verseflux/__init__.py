"""Relate what texts say to measurable properties of accompanying signals, on Spark."""
