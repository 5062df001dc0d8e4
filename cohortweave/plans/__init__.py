"""Composed studies: baseline table, time-varying table, modelling frame."""
