"""corkscrew.functions."""
