"""Operators for preparing catalogue and text data at scale; nothing else in the package imports this subpackage."""
