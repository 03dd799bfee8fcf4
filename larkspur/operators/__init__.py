"""Operators on whole frames: joins and reshaping."""
