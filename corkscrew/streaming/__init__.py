"""corkscrew.streaming."""
