"""acervo: a DataFrame-first analytics engine for document, topic and vector collections."""

__version__ = "0.1.0"
