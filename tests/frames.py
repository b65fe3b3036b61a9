"""What tests of several files share."""


def rows(df):
    return [tuple(r) for r in df.collect()]
