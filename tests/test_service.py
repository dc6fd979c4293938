"""A working tree from disk to search results."""

from __future__ import annotations

import json
import sys

import pytest
from pyspark.sql import functions as F

from nodelake import api, cli, config
from nodelake.errors import InvalidGitRepositoryError, RepoExistsError, RepoNotFoundError
from nodelake.functions import scalars as X
from nodelake.operators import diff, filters
from nodelake.operators.store import Store
from nodelake.service import Repo
from nodelake.sources import repo as tree
from nodelake.sources.ignore import Matcher


@pytest.fixture
def home(tmp_path, monkeypatch):
    for name in ("CONFIG", "DATA", "CACHE"):
        monkeypatch.setenv(f"XDG_{name}_HOME", str(tmp_path / name.lower()))
    return tmp_path


@pytest.fixture
def project(home):
    root = home / "My-Project"
    files = {
        ".git/HEAD": "x", ".gitignore": "*.log\ntemp/\n!keep.log\n", "src/__init__.py": "X = 1\n", "src/app.py": '"""Module."""\n\ndef find_users(name):\n    """Find users by name."""\n    return name\n',
        "README.md": "# Title\n\nText\n", ".github/ci.yml": "a:\n  b: 1\n", "notes.txt": "plain notes about gardens\r\nand more\r", "empty.py": "", "a.log": "x", "keep.log": "kept\n", "temp/x.py": "y = 1", "node_modules/m.js": "x",
        "lib.min.js": "x", "pic.png": "x", "_private.rs": "fn f() {}\n",
    }
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(text.encode())
    (root / "latin.txt").write_bytes(b"Test \xe9 content")
    return root


PATHS = {".gitignore", "src/__init__.py", "src/app.py", "README.md", ".github/ci.yml", "notes.txt", "keep.log", "_private.rs", "latin.txt"}


def test_walk(spark, project):
    got = {r["path"]: r for r in tree.walk(spark, str(project)).collect()}
    assert set(got) == PATHS
    assert got["latin.txt"]["content"] == "Test é content" and got["notes.txt"]["content"] == "plain notes about gardens\nand more\n"
    assert len({r["hash"] for r in got.values()}) == len(got) and all(len(r["hash"]) == 64 for r in got.values())
    small = tree.walk(spark, str(project), config.RepoOptions(max_file_size=20, ignore_patterns=["src/"]))
    assert {r["path"] for r in small.collect()} == {"README.md", ".github/ci.yml", "keep.log", "_private.rs", "latin.txt"}
    with pytest.raises(InvalidGitRepositoryError):
        tree.walk(spark, str(project / "src"))


@pytest.mark.parametrize("patterns,path,ignored", [
    (["build/"], "build/x.py", True), (["build/"], "builder.py", False), (["*.min.*"], "a/script.min.js", True), (["test_*.py"], "test_utils.py", True), (["test_*.py"], "utils.py", False), (["/a.txt"], "b/a.txt", False),
    (["a/**/b"], "a/x/y/b", True), (["a/**/b"], "a/b", True), (["*.log", "!keep.log"], "d/keep.log", False), (["[ab].c"], "a.c", True), (["[!ab].c"], "a.c", False), (["a/*.c"], "a/b/x.c", False), (["# c", ""], "# c", False), (["**/x"], "q/x", True),
    (["q/**"], "q/r/s", True), ([r"\!x"], "!x", True), (["a?c"], "abc", True), (["a?c"], "a/c", False),
])
def test_ignore(spark, patterns, path, ignored):
    m = Matcher(patterns)
    assert m.ignores(path) is ignored
    assert spark.range(1).select(m.column(F.lit(path))).first()[0] is ignored


def test_index_search_and_forget(spark, home, project, capsys):
    store = Store(spark, str(home / "store"))
    repo = Repo.init(project)
    assert Repo.init(project) == repo and Repo.get("My-Project").collection_name == "nodelake_my_project"
    first = repo.index(store)
    assert set(first.files_synced) <= PATHS and first.files_checked == len(PATHS) and first.nodes_updated == 0 and first.errors == []
    assert store.count(repo.collection_name) == first.nodes_added
    again = repo.index(store)
    assert (again.files_synced, again.nodes_added, again.files_deleted) == ([], 0, [])

    hits = repo.search(store, "find users by name", 3, language="python").collect()
    assert hits[0]["node_name"] == "find_users" and hits[0]["documentation"] == "Find users by name." and hits[0]["file_path"] == "src/app.py"
    assert {h["file_path"] for h in repo.search(store, "x", file_path="src/").collect()} == {"src/__init__.py", "src/app.py"}
    assert api.search(store, "My-Project", "gardens", 1)["count"] == 1 and "error" in api.search(store, "none", "x")

    (project / "src/app.py").write_text("def other():\n    pass\n")
    (project / "README.md").unlink()
    (project / "bad.js").write_text("export {}")
    (project / "new.json").write_text('{"a": 1}')
    assert repo.status(store)["documents_indexed_stale"] == 2
    changed = repo.index(store)
    assert changed.files_synced == ["new.json", "src/app.py"] and changed.files_deleted == ["README.md"] and len(changed.errors) == 1
    assert (changed.nodes_added, changed.nodes_updated, changed.nodes_deleted, changed.files_checked) == (1, 1, 1, len(PATHS) + 1)
    paths = {r[0] for r in store.nodes(repo.collection_name).select("document_path").distinct().collect()}
    assert "README.md" not in paths and "new.json" in paths
    assert json.loads(api.status(store, "My-Project"))["documents_indexed_stale"] == 0

    assert cli.main(["index", "My-Project"], store) == 0 and "up to date" in capsys.readouterr().out
    assert cli.main(["search", "gardens", "My-Project", "--limit", "1"], store) == 0 and "notes.txt" in capsys.readouterr().out
    assert cli.main(["status"], store) == 0 and "nodes_indexed" in capsys.readouterr().out
    full = repo.index(store, full=True)
    assert full.nodes_updated == 0 and full.nodes_added == store.count(repo.collection_name)
    store.vacuum(repo.collection_name)
    assert store.delete_by_document_paths(repo.collection_name, ["new.json", "nothing"]) == 2 and store.delete_by_document_paths(repo.collection_name, []) == 0
    assert cli.main(["forget", "My-Project"], store) == 0 and Repo.list() == []
    assert cli.main(["forget", "My-Project"], store) == 1


def test_registry(home, project):
    Repo.init(project)
    for name in ("My-Project", "my_project"):
        other = home / "elsewhere" / name
        (other / ".git").mkdir(parents=True)
        with pytest.raises(RepoExistsError):
            Repo.init(other)
    with pytest.raises(RepoNotFoundError):
        Repo.get("none")
    assert json.loads(api.repos())[0]["name"] == "My-Project"
    Repo._file().write_text("{broken")
    assert Repo.list() == []


def test_options(home, project, monkeypatch):
    assert config.RepoOptions.from_repo(project) == config.RepoOptions()
    (project / "pyproject.toml").write_text('[tool.nodelake]\nmax_sync_files = 7\nunknown = 1\n')
    assert config.RepoOptions.from_repo(project).max_sync_files == 7
    config.RepoOptions.set_value(project, "ignore_patterns", '["a", "b"]')
    assert config.RepoOptions.from_repo(project).ignore_patterns == ["a", "b"]
    (project / config.RepoOptions.FILE).write_text("x = [")
    assert config.RepoOptions.from_repo(project) == config.RepoOptions()  # doesn't fall through to the project's file
    with pytest.raises(KeyError):
        config.RepoOptions.set_value(project, "nothing", "1")
    config.Settings().save()
    monkeypatch.setenv("NODELAKE_STORE__PATH", "/elsewhere")
    monkeypatch.setenv("NODELAKE_SERVER__DEFAULT_TOP_K", "3")
    loaded = config.Settings.load()
    assert loaded.store == {"mode": "local", "path": "/elsewhere"} and loaded.server["default_top_k"] == 3
    monkeypatch.setenv("NODELAKE_STORE__MODE", "other")
    with pytest.raises(ValueError):
        config.Settings.load()


def test_sync_scenarios(spark):
    walked = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("e", "5")], "path string, hash string")
    stored = spark.createDataFrame([("b", "2"), ("c", "old"), ("d", "4")], "path string, hash string")
    planned = diff.plan(diff.classify(walked, stored), 2)
    assert {(r["path"], r["status"], r["action"]) for r in planned.collect()} == {("a", "new", "sync"), ("b", "unchanged", "none"), ("c", "modified", "sync"), ("d", "deleted", "delete"), ("e", "new", "skip")}
    n = spark.createDataFrame([("a", 3), ("c", 0)], "path string, n long")
    assert diff.summary(planned, n).first().asDict() == {"files_checked": 4, "files_synced": 1, "skipped_files": 1, "nodes_deleted": 1, "nodes_added": 3, "nodes_updated": 0}


def test_stream(spark, tmp_path):
    from nodelake import streaming

    store = Store(spark, str(tmp_path / "store"))
    shape = "path string, content string, hash string"
    for i, (name, text) in enumerate((("a.json", '{"x": {}}'), ("a.json", "{}"), ("b.md", "# T\n"))):
        spark.createDataFrame([(name, text, str(i))], shape).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        streaming.sync(spark.readStream.schema(shape).json(str(tmp_path / "in")), store, "c", str(tmp_path / "check")).awaitTermination()
    assert sorted((r["document_path"], r["node_name"]) for r in store.nodes("c").collect()) == [("a.json", "root"), ("b.md", "T")]


def test_search_plan(spark):
    """Filters reach the scan, and the best rows are taken without a sort of all."""
    from nodelake.operators import search

    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding", F.col("label"))
    plan = search.top_k(rows.filter(F.col("label") == 3), search.cosine(F.col("embedding"), [1.0] * 64), 5, "vec_id")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "EqualTo(label,3)" in plan


def test_filters_and_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert filters.node_filter() is None and filters.node_filter(file_path="", language="") is None
    assert [get(X.suffix(F.lit(p))) for p in (".env", "a/.env.example", "x.TAR.GZ", "x.", "d.d/file")] == ["", ".example", ".gz", "", ""]
    assert get(X.decode_text(F.lit(b"a\xe9\r\nb\rc"))) == "aé\nb\nc"
    assert get(X.preview(F.lit("\u00a0 a\nb "))) == "a b..." and get(X.score_text(F.lit(0.5))) == "0.5000"
    assert get(X.strip_docstring(F.lit("r'''x'''"))) == "r'''x'''" and get(X.strip_docstring(F.lit("''' x '''"))) == "x"
    assert [X.effective_limit(x) for x in (0, None, 3)] == [10, 10, 3]


def test_entry_without_the_training_data_operators(monkeypatch):
    import importlib

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setattr(importlib.util, "find_spec", lambda name: None)
    names = __spark_entry__.queries()
    assert "chunk_documents" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
    assert set(__spark_entry__.oracle_sql()) <= set(names)
