"""Operators over solution frames: each takes solutions and gives one, as a DataFrame plan."""
