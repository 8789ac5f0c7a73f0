"""Identify the books in a large document corpus with PySpark.

texts -> ISBNs -> provider answers -> one best record per file.
"""

from colophon.plans.scan import Provider, ScanResult, scan

__all__ = ["Provider", "ScanResult", "scan"]
