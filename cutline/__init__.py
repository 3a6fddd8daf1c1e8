"""cutline: cut ordered series into segments and steer them to quality targets, on Spark."""
