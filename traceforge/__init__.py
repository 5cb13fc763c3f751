"""Reasoning-trace datasets on Spark: build, score, select, grade and compare."""
