"""Registered queries: each maps (spark, sf_dir) to a DataFrame, most with the same statement in plain SQL."""
