"""Modelling frame, weights, balance, outcome models, bootstrap and boosting."""
