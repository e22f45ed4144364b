"""Column builders: cleaning, money, text."""
