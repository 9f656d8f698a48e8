"""DataFrame operators: as-of joins, rolling windows, cross-sections, inference, risk and portfolios."""
