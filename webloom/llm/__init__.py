"""Operators that turn raw documents into training data."""
