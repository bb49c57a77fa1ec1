"""Every registered query on the smallest scale, next to its SQL where there is one."""

import importlib.util
import os

import pytest

from lurewatch.catalog.registry import ORACLE, QUERIES

import lurewatch.catalog  # noqa: F401

SF = "/root/testdata/sf0.001"
_path = os.path.join(os.path.dirname(__file__), "..", "tools", "check.py")
_spec = importlib.util.spec_from_file_location("check", _path)
check = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(check)


@pytest.fixture(scope="module")
def con():
    return check.duck(SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLE)))
def test_matches_sql(spark, con, name):
    assert check.compare(QUERIES[name](spark, SF), con, ORACLE[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
