"""Shapes of plan shared by the operators: the skill axis, look-ups, ranks, stored tables."""
