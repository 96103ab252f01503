"""Labelled cohorts, leakage-safe features and evaluation from event warehouses, on Spark."""
