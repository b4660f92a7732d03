"""Forecast models. Each one fits every series (and every fold) in the same job.

Contract: ``train(keys..., fecha, cantidad)`` is a continuous daily history per key, ``heads(keys...,
h)`` the number of days to forecast. The result is ``keys..., paso (1..h), yhat`` with yhat >= 0;
keys whose history is too short, or whose equations have no solution, get a null yhat.
"""
