"""Risk scores, tiers, confidence, signals and cards."""
