"""Spatial regionalization of species observations on Spark."""
