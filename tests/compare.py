"""Rows of two data frames as sorted tuples that can be compared."""


def _plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if x is None or str(x) in ("<NA>", "NaT", "nan"):
        return None
    if isinstance(x, float):
        return int(x) if x == int(x) and abs(x) < 1e15 else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(_plain(i) for i in x)
    return x


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(str(_plain(x)) for x in r) for r in df.itertuples(index=False))
