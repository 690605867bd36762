"""Operators for training-data pipelines over text.  Nothing outside this folder imports it."""
