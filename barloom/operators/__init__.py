"""Rolling, cross-sectional, portfolio, metric and model operators."""
