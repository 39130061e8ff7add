"""Column functions: text, numbers, dates and durations."""
