"""Whole plans: a run over postings, and the registered queries."""
