"""Threat-verdict and phishing-mail analytics as PySpark DataFrame jobs."""
