"""Operators for preparing large language-model training data.

Nothing outside this subpackage imports it; ``queries`` holds the registry.
"""
