"""Operators with SQL, on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from oracle_check import compare, connect  # noqa: E402

from blockloom.llm.queries import ORACLE, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_operator_equals_oracle(spark, name):
    assert compare(spark, connect(SF), SF, name, QUERIES[name], ORACLE[name]) is None
