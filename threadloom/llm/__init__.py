"""Operators for preparing large text collections. Nothing outside this folder imports it."""
