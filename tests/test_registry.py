import math

import duckdb
import pytest

from spanloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _row(r):
    return tuple("" if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v for v in r)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_against_duckdb(spark, data, name):
    df = registry.queries()[name](spark, data)
    columns = sorted(df.columns)
    ours = sorted((_row(r) for r in df.select(*columns).collect()), key=str)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    cursor = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert ours == sorted((_row([r[i] for i in at]) for r in cursor.fetchall()), key=str)


def test_token_display(spark, tmp_path):
    """Every token of every line, also after the third and with slashes or without letters."""
    texts = {1: "a b c d\n\nand/or 5% %2F ... Éa", 2: "", 3: None, 4: "/ // x"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.text_id, r.s_no, r.i): r.form for r in registry.queries()["token_display"](spark, str(tmp_path)).collect()}
    assert got == {(k, n, i): w for k, t in texts.items() for n, line in enumerate((t or "").split("\n")) for i, w in enumerate(line.split())}
