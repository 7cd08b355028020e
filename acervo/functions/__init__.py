"""acervo.functions."""
