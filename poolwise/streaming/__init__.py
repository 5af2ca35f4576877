"""Votes over trajectories that are still arriving."""
