"""A PySpark-native engine for population-scale variant tables."""
