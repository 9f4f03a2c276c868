"""Scalar functions and how they are lifted over dimensions."""
