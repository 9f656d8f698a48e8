"""Whole plans: adapters of tables, the feature panel, the research run and the weekly analyses."""
