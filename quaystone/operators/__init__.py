"""DataFrame-to-DataFrame operators, for `DataFrame.transform`."""
