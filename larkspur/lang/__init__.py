"""Source text to syntax trees: one lexer, two surface syntaxes."""
