"""Analytics over pools of sampled reasoning trajectories, as Spark DataFrame plans."""
