"""Queries of the training-data operators against their SQL, on the smallest tables."""
import pytest

import __spark_entry__ as entry
from compare import compare, duck
from tidemark.llm.queries import OP1_SQL
from tidemark.llm.registry import ORACLES, load

load()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    ok, note, _ = compare(spark, "/root/testdata/sf0.001", entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note


def test_every_operator_and_the_pipeline_are_registered():
    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names


def test_quotation_sql_sees_quotes(tmp_path):
    """The given conversations quote nothing: the SQL is held to a made one."""
    con = duck("/root/testdata/sf0.001")
    con.execute("CREATE TABLE said AS SELECT * FROM (VALUES (1, 0, 'u', 'Hi  there.\n\nTwo\nlines'), (1, 1, 'a', '> hi there.\nyes'), "
                "(1, 2, 'u', 'On May 1 A wrote:\n> > hi there.\n> yes\nno'), (1, 3, 'u', '> unsaid\nx')) t(conv_id, turn, role, text)")
    got = con.sql(OP1_SQL.replace("FROM conversations", "FROM said")).order("turn").fetchall()
    assert [(r[3], r[4], r[5], r[6], r[7], r[8]) for r in got] == [
        ("Hi  there.\n\nTwo\nlines", 0, 0, -1, 0, 0), ("yes", 1, 1, 0, 0, 1), ("no", 2, 2, 1, 0, 2), ("x", 1, 0, -1, 3, 3)]
