"""Acutance: edge-sharpness analytics and corpus preparation as Spark jobs."""
