"""DataFrame transforms: cleaning, metering, grids, joins, features, models."""
