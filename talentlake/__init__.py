"""Talent-matching analytics on PySpark: extraction, normalisation, matching, calibration and reporting jobs."""
