"""Whole screens, composed of the operators."""
