"""Scalar functions as column expressions, and text segmentation."""
