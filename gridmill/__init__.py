"""Spark jobs for datasets of sampled functions and for tables of experiment runs."""
