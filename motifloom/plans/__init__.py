"""Strategies and lazy enumeration of motifs and motiflets."""
