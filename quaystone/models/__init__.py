"""Walk-forward evaluation, tree models, isolation forest, calibration and attribution."""
