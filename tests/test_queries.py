"""Every registered query runs; those with SQL give DuckDB's rows."""

import duckdb
import pytest

from cloakwork.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canonical(rows):
    return sorted(repr(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(name, spark, duck):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = df.select(*columns).collect()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in result.fetchall()]
    assert canonical(got) == canonical(want)


def test_triage_takes_capitals_letter_for_letter(spark, tmp_path):
    odd = [c for c in map(chr, range(0x20, 0xFFFF)) if not 0xD800 <= ord(c) < 0xE000 and len(c.upper()) > 1]
    rows = [(8226 + 11550 * i, f"{c} and so{c}") for i, c in enumerate(odd)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(catalogue.oracle_sql()["triage_buckets"]).fetchall()
    assert len(odd) > 100 and canonical(catalogue.queries()["triage_buckets"](spark, str(tmp_path)).select("doc_id", "bucket").collect()) == canonical(want)
