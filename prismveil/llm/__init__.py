"""Operators of the training-data problems that need their own algorithms: see README for what is there."""
