"""Operators on item-feature graphs, sets, rankings, patterns and registries."""
