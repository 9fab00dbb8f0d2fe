"""Column functions: payload conversion, hashing, detectors, judge rules, metrics."""
