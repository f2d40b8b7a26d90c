"""Physical-plan helpers: joins that survive hot keys, and ranks without one big window."""
