"""The pipeline language: text to syntax tree."""
