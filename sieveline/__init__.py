"""sieveline: content filtering, log analytics and training-data operators on Spark."""
