"""corkscrew.operators."""
