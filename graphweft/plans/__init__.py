"""From algebra to one DataFrame."""
