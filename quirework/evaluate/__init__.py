"""Text metrics, source reduction and the regression gate."""
