import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sql, sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return frame_rows(c.execute(sql).df())


def frame_rows(pdf):
    names = sorted(pdf.columns)
    return names, sorted(map(repr, pdf[names].astype(object).where(pdf[names].notna(), None).values.tolist()))


def same_as_sql(query, sql, spark, sf_dir):
    got = query(spark, sf_dir)
    names = sorted(got.columns)
    want_names, want = sql_rows(sql, sf_dir)
    assert names == want_names
    plain = lambda v: v.item() if hasattr(v, "item") else v
    assert sorted(repr([plain(r[n]) for n in names]) for r in got.collect()) == want
