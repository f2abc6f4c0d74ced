import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_corpus_operators(tmp_path):
    """The rest imports and lists its queries where the separable part is gone."""
    for name in ("quillon", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    package = tmp_path / "quillon"
    package.mkdir()
    for p in (ROOT / "quillon").iterdir():
        if p.name != "llm":
            (package / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'g16_pagerank' in q and 'pipeline' not in q and not any(x.startswith('op') for x in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
