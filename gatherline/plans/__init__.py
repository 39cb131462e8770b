"""Questions users ask, composed of operators, and the catalog of checked queries."""
