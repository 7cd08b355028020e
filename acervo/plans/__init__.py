"""acervo.plans."""
