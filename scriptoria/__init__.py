"""Scriptoria: a document-corpus analytics engine made of Spark DataFrame plans."""
