"""acervo.streaming."""
