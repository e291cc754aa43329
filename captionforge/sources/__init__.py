"""Readers: tables, text formats, archives, image folders, streams of files."""
