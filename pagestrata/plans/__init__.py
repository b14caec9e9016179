"""Whole jobs built from the operators: corpus parse, crawl, reports."""
