"""Offer analytics and catalogue data processing as PySpark plans."""
