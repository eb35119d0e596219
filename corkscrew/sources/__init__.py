"""corkscrew.sources."""
