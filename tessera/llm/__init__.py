"""Operators for preparing text, audio, web and vector data for model training."""
