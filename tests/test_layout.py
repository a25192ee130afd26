"""The library stands without its training-data subpackage, and every named query is described."""

from pathlib import Path

from evidentia.plans import catalog

ROOT = Path(__file__).parent.parent


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "evidentia").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "evidentia").parts:
            assert "evidentia.llm" not in path.read_text(), path


def test_lineage_is_never_cut_on_executors():
    for path in [*ROOT.glob("*.py"), *(ROOT / "evidentia").rglob("*.py")]:
        assert "localCheckpoint" not in path.read_text(), path


def test_sql_belongs_to_queries():
    assert set(catalog.ORACLE_SQL) == set(catalog.QUERIES)
