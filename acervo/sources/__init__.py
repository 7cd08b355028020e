"""acervo.sources."""
