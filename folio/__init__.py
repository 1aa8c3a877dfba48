"""Positioned-text extraction from PDF documents as Spark relations."""
