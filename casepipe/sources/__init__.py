"""Readers: HTML listings and pages, search-result JSON, CSV tables and
annotation folders, Akoma Ntoso XML, IOB token files."""
