"""Inputs: location tables, spines of days, years and samples, and the fixed dimensions."""
