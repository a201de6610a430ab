"""Astronomical events as Spark tables: sunrise and sunset, seasons, cross-quarter days, moon phases and calendar feeds."""
