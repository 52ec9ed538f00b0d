"""Siftline: content-security analytics over DataFrames of untrusted text and files."""
