"""Compositions of operators: research runs and backtests."""
