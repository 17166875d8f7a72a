"""Column expressions: geometry, angles, time, thresholds, scores, names."""
