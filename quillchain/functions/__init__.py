"""Column functions: cleaning, tokens, sentences, states."""
