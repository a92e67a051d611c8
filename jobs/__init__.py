"""Runnable jobs: each has a command line, a small settings file and a function that takes a session."""
