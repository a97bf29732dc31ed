"""Runnable jobs over the tables, each with a command line and a config file."""
