"""Plans of several steps: filled gaps, the first of each group, results as trees."""
