"""Query modules; importing them registers their queries."""

from . import analysis, budgets, certificates, domain, enclosures, exactly, governed, lookups, measured, numeric, ordered, ranged, recurring, reported, solving, sources, spectra, stores  # noqa: F401
