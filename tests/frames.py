"""What several tests share."""


def rows(df, *order):
    """Rows as tuples, sorted by their text."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
