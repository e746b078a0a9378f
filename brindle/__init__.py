"""brindle: evidence-text analytics on Spark."""
