"""Operators for preparing language-model training data.

Self-contained: nothing else in the package imports this subpackage, and the
driver entry file registers its queries only when it can be imported.
"""
