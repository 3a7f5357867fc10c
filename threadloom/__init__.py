"""Conversation analytics on PySpark: every operator is DataFrame -> DataFrame."""
