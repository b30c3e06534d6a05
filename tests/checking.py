"""What tests share."""

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def plain(v):
    """A value as both engines give it."""
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if hasattr(v, "asDict"):
        return plain(list(v.asDict().values()))
    try:
        return round(float(v), 6) if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def same_rows(df, duck, sql):
    names = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    found = duck.execute(sql)
    have = [d[0] for d in found.description]
    assert sorted(have) == names
    want = sorted(repr([plain(r[have.index(c)]) for c in names]) for r in found.fetchall())
    assert got == want
