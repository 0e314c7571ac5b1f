"""Column-level helpers: flags, binning, bands, special functions, joins."""
