"""Table operators of the language."""
