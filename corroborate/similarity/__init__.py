"""The exact set-similarity join of texts, and what it shares with the operators for training data."""
