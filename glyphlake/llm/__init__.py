"""Operators for preparing language-model training text. Nothing else imports this package."""
