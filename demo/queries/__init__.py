"""One module per family of operators; importing them registers the queries."""
from demo.queries import distribution, filters, keys_values, mix, preparation, summary, targets, tracker  # noqa: F401
