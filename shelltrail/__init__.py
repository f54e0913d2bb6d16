"""Operating guides from shell command histories, on Spark."""
