"""Locating noisy copies of known table fragments in page text, and cutting the text around them, as Spark plans."""
