"""Readers of documents and libraries, and writers of exports."""
