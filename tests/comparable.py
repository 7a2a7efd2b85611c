"""Rows of a DataFrame in a form that tests can compare."""


def rows(df):
    """Order-free, comparable rows; doubles rounded to twelve significant digits."""

    def cell(v):
        if isinstance(v, float):
            return f"{v:.12g}" if v else "0"
        return str(v)

    columns = sorted(df.columns)
    return sorted(tuple(cell(r[c]) for c in columns) for r in df.select(*[f"`{c}`" for c in columns]).collect())
