"""Reusable relational operators: interval joins, anchors, point-in-time windows, ordered
aggregates (distributed prefix sums), profiles and histograms."""
