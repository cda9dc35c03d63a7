def rows(df, *order):
    """Rows as tuples, sorted with NULLs first."""
    names = order or df.columns
    out = [tuple(r[c] for c in names) for r in df.select(*[f"`{c}`" for c in names]).collect()]
    return sorted(out, key=lambda r: [(v is not None, str(type(v)), v) for v in r])
