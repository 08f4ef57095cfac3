"""Analytics for GPS trajectories and physics-based ride simulation, on Spark DataFrames."""
