"""Writers of call sets, site sets and tables."""
