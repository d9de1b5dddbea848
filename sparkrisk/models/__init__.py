"""Models, explanations and thresholds."""
