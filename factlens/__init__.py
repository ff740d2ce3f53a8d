"""Analytics for multilingual knowledge-probe data on Spark."""
