"""Corpus cataloguing, triage, segmentation, translation and annotation as PySpark DataFrames."""
