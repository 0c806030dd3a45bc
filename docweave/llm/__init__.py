"""Operators for preparing text corpora for language-model training.

Nothing else in the package imports this subpackage; the driver entry adds its queries only where it is present.
"""
