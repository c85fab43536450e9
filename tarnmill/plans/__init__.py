"""Whole jobs: stages that write their tables to a shared folder and read them back."""
