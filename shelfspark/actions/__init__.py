"""Side effects, on the driver only."""
