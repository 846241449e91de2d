import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    import __spark_entry__

    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries)


def test_entry_without_the_removable_parts(tmp_path):
    """Neither the llm folders nor the pipeline are needed by the rest."""
    (tmp_path / "graphloom").mkdir()
    for p in (ROOT / "graphloom").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "graphloom" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q_traverse_out' in q and 'pipeline' not in q and not any(x.startswith('op') for x in q); e.oracle_sql()"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin"}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


@pytest.mark.parametrize("name", ["q_filter_take", "x_optional_required", "x_subgraph_edges", "m_apply_plan", "a_celf", "a_k1coloring", "a_sllpa", "r_astar"])
def test_queries_run(spark, name):
    import __spark_entry__

    assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").columns
