"""Column expressions: text cleaning, labels, features and hash order."""
