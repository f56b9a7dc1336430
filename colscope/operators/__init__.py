"""DataFrame operators. Every one returns a DataFrame (or a fitted model) and keeps data on Spark."""
