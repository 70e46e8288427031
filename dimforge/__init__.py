"""Dimensional warehouse engine on Spark DataFrames.

Operators are pure functions from DataFrames (and a declarative model) to DataFrames;
only :mod:`dimforge.sources.writers` and the planner run actions.
"""
