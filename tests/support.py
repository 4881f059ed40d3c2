"""What the tests share: the small tables and the comparison with SQL."""

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns, rows):
    """Rows by the columns in alphabetical order, sorted, with floats rounded."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: f"{v:.7g}" if isinstance(v, float) else str(v)
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def same_as_sql(duck, df, sql):
    found = duck.sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(found.columns, found.fetchall())
