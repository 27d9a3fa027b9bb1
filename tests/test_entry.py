"""The driver contract: names, SQL, and life without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= 60


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["id", "title", "link", "source", "published", "category_id", "content_hash"]


def test_without_llm():
    code = "import sys; sys.modules['loomwire.llm'] = None; import __spark_entry__ as e; assert 'components' in e.queries() and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_groups_of_a_fixed_number_grow_with_the_table(spark):
    import __spark_entry__ as e

    stats = e.queries()["cluster_stats"](spark, "/root/testdata/sf0.001").first()
    assert (stats["total"], stats["multi"], stats["max_size"]) == (97, 97, 3)
    assert e.queries()["cluster_confidence"](spark, "/root/testdata/sf0.001").count() == 97
