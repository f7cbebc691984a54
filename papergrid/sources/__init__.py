"""Readers and writers of notes, saved pages, payload files and reports."""
