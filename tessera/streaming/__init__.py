"""Streams over folders of files, run until what is there has been read."""
