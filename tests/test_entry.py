import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")


def core():
    return [k for k in entry.queries() if not k.startswith("p") or k.startswith("p1_") or not k[1].isdigit()]


def test_names_and_sql_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p1_found", "normalize_text", "knowledge_pipeline"} <= set(entry.queries())


def test_the_core_does_not_need_the_text_package():
    code = "import sys; sys.modules['docloom.llm'] = None\nimport __spark_entry__ as e\nassert 'p1_found' in e.queries() and 'p2_found' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0
    for p in (ROOT / "docloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "docloom.llm" not in p.read_text(), p


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", core())
def test_query_equals_its_sql(spark, name):
    sys.path.insert(0, str(ROOT / "tools"))
    import compare
    import pandas as pd

    df = entry.queries()[name](spark, str(DATA))
    got = pd.DataFrame.from_records([r.asDict() for r in df.collect()], columns=df.columns)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(df.columns) > 0
        return
    con = compare.views(str(DATA)).execute(sql)
    want = pd.DataFrame.from_records(con.fetchall(), columns=[d[0] for d in con.description])
    assert sorted(got.columns) == sorted(want.columns)
    assert compare.canon(got) == compare.canon(want)
