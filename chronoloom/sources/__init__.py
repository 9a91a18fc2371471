"""Readers and writers of corpora and of the text formats that feed them."""
