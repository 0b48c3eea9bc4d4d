import pathlib
import re

import __spark_entry__ as entry

ROOT = pathlib.Path(__file__).parents[1]


def test_core_does_not_use_the_llm_subpackage():
    for path in (ROOT / "gantry").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "gantry").parts:
            assert not re.search(r"gantry\.llm|from gantry import llm", path.read_text()), path


def test_nothing_depends_on_one_machine_or_cuts_rows():
    for path in (ROOT / "gantry").rglob("*.py"):
        text = path.read_text()
        assert "localCheckpoint" not in text and ".toDF(" not in text, path


def test_sql_only_for_known_queries():
    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries) and len(queries) > 60
