"""acervo.operators."""
