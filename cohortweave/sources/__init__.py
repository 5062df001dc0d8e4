"""Reading and writing tables."""

from cohortweave.sources.tables import expect, harmonise, load, save, save_tsv

__all__ = ["expect", "harmonise", "load", "save", "save_tsv"]
