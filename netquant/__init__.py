"""Peptide-protein network and site-ratio analytics on PySpark DataFrames."""
