"""A query's rows and its SQL's rows over the same tables, in one form."""

from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")


def both(spark, query, sql):
    """Sorted rows of the Spark query and of DuckDB, columns by name."""
    df = query(spark, str(DATA))
    names = sorted(df.columns)
    db = duckdb.connect()
    for table in DATA.glob("*.parquet"):
        db.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    made = db.execute(sql)
    order = sorted(range(len(names)), key=lambda i: made.description[i][0])
    assert [made.description[i][0] for i in order] == names
    return sorted(str(tuple(r)) for r in df.select(*names).collect()), sorted(str(tuple(r[i] for i in order)) for r in made.fetchall())
