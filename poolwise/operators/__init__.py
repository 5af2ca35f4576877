"""Operators over pools of trajectories: votes, selection, accounting, scoring."""
