"""Offer-to-catalogue matching on Spark."""
