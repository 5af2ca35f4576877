"""Where problems and trajectories come from, and where results go."""
