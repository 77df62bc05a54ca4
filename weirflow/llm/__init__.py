"""Operators of a large training-data pipeline. Nothing else imports them."""
