"""Larkspar: point-in-time pattern analytics and corpus preparation on Spark."""
