"""Query plans: each function takes (spark, table folder) and returns a DataFrame."""
