"""Column-level building blocks: labels, grades, ratios, scales, exact percentiles, running totals, PSI."""
