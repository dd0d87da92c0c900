import os
import shutil
import subprocess
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_works_without_the_corpus_operators(tmp_path):
    shutil.copytree(f"{ROOT}/wayfold", tmp_path / "wayfold", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(k.startswith('op') for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables aren't here")
def test_queries_agree_with_their_sql(spark):
    from wayfold.plans import catalog

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    plain = lambda rows: sorted(tuple("null" if v is None or v != v else round(float(v), 4) if isinstance(v, int | float) and not isinstance(v, bool) else str(v) for v in r) for r in rows)
    sql = catalog.oracle_sql()
    for name, query in catalog.queries().items():
        df = query(spark, SF)
        got = df.collect()
        if name not in sql:
            assert got or name == "walk_graph", name  # small blobs have no middle line
            continue
        rel = con.sql(sql[name])
        assert sorted(rel.columns) == sorted(df.columns), name
        order = [rel.columns.index(c) for c in df.columns]
        assert plain(got) == plain([tuple(r[i] for i in order) for r in rel.fetchall()]), name
