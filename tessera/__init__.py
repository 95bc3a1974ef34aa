"""Knowledge-registry analytics and training-data operators on Spark."""
