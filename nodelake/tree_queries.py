"""Queries that go through a working tree, a registry, a store or the front ends, over files made from the shared tables.

Trees are written by the executors into a folder that all of them see: under ``spark.checkpoint.dir`` where it is set, else,
in a local session, a temporary one. Registry and settings are kept in such a folder, too, for as long as a query runs."""

from __future__ import annotations

import atexit
import contextlib
import io
import json
import os
import shutil
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import Repo, api, cli, config, parsers
from .errors import InvalidGitRepositoryError, RepoExistsError, RepoNotFoundError
from .functions import scalars as X
from .operators import embed
from .operators.store import SCHEMA, Store
from .plans.synth import CASES
from .sources import repo as tree


def _folder(spark: SparkSession) -> Path:
    shared = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file:")
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if shared:
        os.makedirs(shared, exist_ok=True)
    path = Path(tempfile.mkdtemp(prefix="nodelake-tree-", dir=shared or None))
    atexit.register(shutil.rmtree, path, True)
    return path


@contextlib.contextmanager
def _home(path: Path, **environment: str) -> Iterator[None]:
    """Settings and registry in a folder of their own."""
    new = {f"XDG_{n}_HOME": str(path / n.lower()) for n in ("CONFIG", "DATA", "CACHE")} | environment
    old = {k: os.environ.get(k) for k in new}
    os.environ.update(new)
    try:
        yield
    finally:
        for k, v in old.items():
            os.environ.pop(k, None) if v is None else os.environ.__setitem__(k, v)


def _write(files: DataFrame, root: Path) -> None:
    """Files (``path``, ``raw``) below a root, by the executors."""

    def run(rows) -> None:
        for r in rows:
            at = root / r["path"]
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_bytes(bytes(r["raw"]))

    files.foreachPartition(run)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _few(spark: SparkSession, sf_dir: str, name: str) -> list:
    """All rows of a table of fixed size (nation, region)."""
    return sorted(tuple(r) for r in _table(spark, sf_dir, name).collect())


_LATIN = r"^[\x{0}-\x{FF}]*$"


def _text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, every fifth in Latin-1 (where it can be), every seventh with CR LF."""
    docs = _table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 7 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text"))
    latin = (F.col("doc_id") % 5 == 0) & F.col("text").rlike(_LATIN)
    raw = F.when(latin, F.encode(F.when(latin, text).otherwise(""), "ISO-8859-1")).otherwise(F.encode(text, "UTF-8"))
    return docs.select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), raw.alias("raw"))


def decoded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = X.decode_text(F.col("raw"))
    return _text_files(spark, sf_dir).select("doc_id", F.octet_length("raw").cast("long").alias("size_bytes"), X.content_hash(text).alias("text_hash"))


_SIZE = """CASE WHEN doc_id % 5 = 0 AND NOT regexp_matches(text, '[^\\x{0}-\\x{FF}]') THEN length(text) ELSE strlen(text) END + CASE WHEN doc_id % 7 = 0 THEN length(text) - length(replace(text, chr(10), '')) ELSE 0 END"""

#: What stands beside the documents, by nation, and whether it is read.
_BESIDE = (
    (".hidden/{k}.md", "# {n}", True), ("nation/_{k}.py", "x = {k}", True), ("nation/keep.log", "kept", True), ("nation/{k}.log", "{n}", False), ("skip/{k}.py", "x = 1", False), ("nation/{k}.min.js", "x", False), ("nation/{k}.PNG", "x", False),
    ("nation/empty{k}.py", "", False), ("node_modules/{k}.js", "x", False), ("large/{k}.txt", "{n}" * 40_000, False), ("global/{k}.txt", "{n}", False),
)


def tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a working tree: what is ignored, binary, minified, empty or too large is left out."""
    root = _folder(spark) / "tree"
    nation = _table(spark, sf_dir, "nation")
    fill = lambda x: F.replace(F.replace(F.lit(x), F.lit("{k}"), F.col("n_nationkey").cast("string")), F.lit("{n}"), F.col("n_name"))
    beside = [nation.select(fill(p).alias("path"), F.encode(fill(t), "UTF-8").alias("raw")) for p, t, _ in _BESIDE]
    files = _text_files(spark, sf_dir).select("path", "raw")
    for one in beside:
        files = files.unionByName(one)
    _write(files.dropDuplicates(["path"]), root)
    (root / ".git").mkdir()
    (root / ".gitignore").write_text("*.log\n!keep.log\n")
    with _home(root.parent, NODELAKE_IGNORE_PATTERNS='[".git/", "node_modules/", "global/"]'):
        return tree.walk(spark, str(root), config.RepoOptions(ignore_patterns=["skip/", ".gitignore"], max_file_size=240_000)).select("path", "size_bytes", "hash", X.content_hash(F.col("content")).alias("text_hash"))


def _beside_sql() -> str:
    fill = lambda x: f"replace(replace('{x}', '{{k}}', CAST(n_nationkey AS VARCHAR)), '{{n}}', n_name)"
    return " UNION ".join(f"SELECT {fill(p)} AS path, {fill(t)} AS text, strlen({fill(t)}) AS size_bytes FROM nation" for p, t, read in _BESIDE if read)


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories registered, listed, fetched and removed, and the options of each: own file, project's file, defaults."""
    home, rows = _folder(spark), []
    said = lambda f, *a: _said(f, (InvalidGitRepositoryError, RepoExistsError, RepoNotFoundError), *a)
    with _home(home):
        for key, name, _ in _few(spark, sf_dir, "nation"):
            at = home / "work" / name
            (at / (".git" if key % 4 else "none")).mkdir(parents=True)
            if key % 4 == 1:
                config.RepoOptions(collection=f"c_{key}", max_sync_files=key + 1).save(at)
            elif key % 4 == 2:
                (at / "pyproject.toml").write_text(f"[tool.nodelake]\nmax_file_size = {key * 10}\nunknown = 1\n")
            elif key % 4 == 3:
                (at / config.RepoOptions.FILE).write_text("x = [")
            first, again = said(Repo.init, at), said(Repo.init, at)
            (other := home / "elsewhere" / name / ".git").mkdir(parents=True)
            clash = said(Repo.init, other.parent) if key % 4 else "-"
            options = config.RepoOptions.from_repo(at)
            listed = [r.name for r in Repo.list()]
            if name in listed and key % 3 == 0:
                Repo.remove(name, Store(spark, str(home / "store")))
            rows.append((key, name, first if isinstance(first, str) else first.collection_name, first == again, clash if isinstance(clash, str) else "registered", options.max_sync_files, options.max_file_size, name in listed, isinstance(said(Repo.get, name), Repo)))
        Repo._file().write_text("{broken")
        left = len(Repo.list())
    return spark.createDataFrame([(*r, left) for r in rows], "n_nationkey int, name string, outcome string, same_again boolean, clash string, max_sync_files long, max_file_size long, listed boolean, there_in_the_end boolean, in_a_broken_file long")


def _said(f, errors, *a):
    try:
        return f(*a)
    except errors as e:
        return type(e).__name__


def settings_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings from the environment over a file over defaults."""
    home, rows = _folder(spark), []
    for key, name in _few(spark, sf_dir, "region"):
        mode = ("local", "memory", "remote", "other")[key % 4]
        with _home(home / name):
            config.Settings(server={"port": 1000 + key, "default_top_k": 7}).save()
            with _home(home / name, NODELAKE_SERVER__DEFAULT_TOP_K=str(key + 1), NODELAKE_STORE__MODE=mode, NODELAKE_IGNORE_PATTERNS=f'["{name}"]'):
                got = _said(config.Settings.load, ValueError)
            if isinstance(got, str):
                rows.append((key, got, None, None, None, None, None))
            else:
                rows.append((key, got.store["mode"], got.server["port"], got.server["default_top_k"], got.server["host"], got.ignore_patterns, got.embedding["model_name"]))
    return spark.createDataFrame(rows, "r_regionkey int, mode string, port long, top_k long, host string, patterns array<string>, model string")


def _sources(spark: SparkSession, sf_dir: str, **texts: str) -> DataFrame:
    """A file for each nation and text; ``{k}`` and ``{n}`` stand for its key and name."""
    nation, out = _table(spark, sf_dir, "nation"), None
    for suffix, text in texts.items():
        content = F.replace(F.replace(F.lit(text), F.lit("{k}"), F.col("n_nationkey").cast("string")), F.lit("{n}"), F.col("n_name"))
        part = nation.select(F.concat(F.lit(f"{suffix}/f"), F.col("n_nationkey").cast("string"), F.lit(f".{suffix}")).alias("path"), content.alias("content"), F.col("n_nationkey").alias("k"))
        out = part if out is None else out.unionByName(part)
    return out


def store_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections created, filled, changed and dropped in each mode of the store."""
    home, rows = _folder(spark), []
    docs = _sources(spark, sf_dir, md=CASES["markdown"][0].text).withColumn("hash", X.document_hash(F.col("path"), F.col("content")))
    nodes = parsers.nodes(docs).drop("error").withColumn("embedding", F.array(F.lit(1.0).cast("float"))).select(*SCHEMA.names)
    for mode, settings in (("local", {"path": str(home / "a")}), ("memory", {}), ("remote", {"url": f"file:{home}/b"})):
        store = Store.connect(spark, {"mode": mode} | settings)
        store.MERGE = 3
        store.ensure("c")
        store.ensure("c")
        counts = [store.count("c"), store.upsert("c", nodes), store.count("c"), store.upsert("c", nodes.filter("start_line = 1")), store.count("c"), store.upsert("c", nodes.filter("false"))]
        for k in range(5):
            counts[6:] = [store.delete_by_document_paths("c", [f"md/f{k}.md", "none"]), store.count("c")]
        store.upsert("c", nodes.filter("document_path = 'md/f0.md'"))
        store.compact("c")
        store.vacuum("c")
        counts.append(store.count("c"))
        store.drop("c")
        rows.append((mode, *counts, store.count("c")))
    names = ("created", "upserted", "filled", "upserted_again", "filled_again", "upserted_none", "deleted_paths", "after_deletes", "after_compacting", "dropped")
    return spark.createDataFrame(rows, "mode string, " + ", ".join(f"{n} long" for n in names))


_CHANGED = "def g{k}():\n    pass\n"


def _project(spark: SparkSession, sf_dir: str, home: Path) -> Repo:
    root = home / "Some Project"
    _write(_sources(spark, sf_dir, py=CASES["python"][0].text, json=CASES["json"][0].text, js="export {}\n").select("path", F.encode("content", "UTF-8").alias("raw")), root)
    (root / ".git").mkdir()
    return Repo.init(root)


def repo_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of indexing a tree, once more after no change, after changes under a cap, after the rest, and in full."""
    home, rows = _folder(spark), []
    with _home(home):
        repo, store = _project(spark, sf_dir, home), Store(spark, str(home / "store"))

        def index(run: int, **how) -> None:
            r = repo.index(store, **how)
            rows.append((run, r.files_checked, len(r.files_synced), len(r.files_deleted), r.skipped_files, r.nodes_added, r.nodes_updated, r.nodes_deleted, len(r.errors), store.count(repo.collection_name)))

        index(1)
        index(2)
        _write(_sources(spark, sf_dir, py=_CHANGED).filter("k % 2 = 0").select("path", F.encode("content", "UTF-8").alias("raw")), Path(repo.path))
        for key, _, _ in _few(spark, sf_dir, "nation"):
            (Path(repo.path) / f"js/f{key}.js").unlink()
            if key % 3 == 0:
                (Path(repo.path) / f"json/f{key}.json").unlink()
        config.RepoOptions.set_value(repo.path, "max_sync_files", "5")
        config.RepoOptions.set_value(repo.path, "ignore_patterns", f'["{config.RepoOptions.FILE}"]')
        index(3)
        config.RepoOptions.set_value(repo.path, "max_sync_files", "500")
        index(4)
        index(5, full=True)
    return spark.createDataFrame(rows, "run int, files_checked long, files_synced long, files_deleted long, skipped_files long, nodes_added long, nodes_updated long, nodes_deleted long, errors long, nodes_stored long")


_RUNS = """WITH n AS (SELECT count(*) AS n, count(*) FILTER (n_nationkey % 2 = 0) AS even, count(*) FILTER (n_nationkey % 3 = 0) AS third FROM nation),
  c AS (SELECT *, {py} * n AS py, {json} * n AS json, {py} * (n - even) + even AS py2, {json} * (n - third) AS json2 FROM n)
SELECT CAST(run AS INT) AS run, CAST(checked AS BIGINT) AS files_checked, CAST(synced AS BIGINT) AS files_synced, CAST(deleted AS BIGINT) AS files_deleted, CAST(skipped AS BIGINT) AS skipped_files, CAST(added AS BIGINT) AS nodes_added, CAST(updated AS BIGINT) AS nodes_updated, CAST(deleted AS BIGINT) AS nodes_deleted, CAST(errors AS BIGINT) AS errors, CAST(stored AS BIGINT) AS nodes_stored FROM (
  SELECT 1 AS run, 3 * n AS checked, 2 * n AS synced, 0 AS deleted, 0 AS skipped, py + json AS added, 0 AS updated, n AS errors, py + json AS stored FROM c
  UNION ALL SELECT 2, 3 * n, 0, 0, 0, 0, 0, n, py + json FROM c
  UNION ALL SELECT 3, 2 * n - third, 5, third, even - 5, 0, 5, 0, py - 5 * {py} + 5 + json2 FROM c
  UNION ALL SELECT 4, 2 * n - third, even - 5, 0, 0, 0, even - 5, 0, py2 + json2 FROM c
  UNION ALL SELECT 5, 2 * n - third, 2 * n - third, 0, 0, py2 + json2, 0, 0, py2 + json2 FROM c)"""


def letters(texts: pd.Series) -> pd.Series:
    """An embedder that SQL can follow: how often each letter occurs."""
    return pd.Series([[float(t.lower().count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts.fillna("")], dtype=object)


_LETTERS = "list_transform(string_split('a,b,c,d,e,f,g,h,i,j,k,l,m,n,o,p,q,r,s,t,u,v,w,x,y,z', ','), lambda c: CAST(length({0}) - length(replace({0}, c, '')) AS DOUBLE))"


def embedded_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by an embedder that is chosen by its name, in batches."""
    chosen = embed.embedder("nodelake.tree_queries:letters")
    text = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    vector = embed.embed(F.regexp_replace(text, "[^a-z]", ""), chosen, 7)
    return _table(spark, sf_dir, "documents").select("doc_id", F.transform(vector, lambda x: x.cast("double")).alias("embedding"))


def embedded_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents an embedder sees, and whether it ever gets more than its batch."""
    size = embed.embed(F.col("text"), lambda texts: pd.Series([[float(len(texts))]] * len(texts), dtype=object), 3)[0]
    return _table(spark, sf_dir, "documents").agg(F.count(size).alias("n"), (F.max(size) <= 3).alias("within"))


def repo_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the hits for each region's name among nations' names, in order, with a limit of 3, 0 (the default) and none."""
    home, rows = _folder(spark), []
    with _home(home, NODELAKE_EMBEDDING__MODEL_NAME="nodelake.tree_queries:letters"):
        root = home / "nations"
        _write(_sources(spark, sf_dir, md="# {n}\n", txt="{n}").select("path", F.encode(F.lower("content"), "UTF-8").alias("raw")), root)
        (root / ".git").mkdir()
        store = Store(spark, str(home / "store"))
        Repo.init(root).index(store)
        for key, name in _few(spark, sf_dir, "region"):
            for limit in (3, 0, None):
                got = api.search(store, "nations", name, limit, language="markdown", file_path="md/")
                rows += [(key, -1 if limit is None else limit, i, round(h["score"], 5), got["count"], h["node_type"], h["end_line"]) for i, h in enumerate(got["results"])]
    return spark.createDataFrame(rows, "r_regionkey int, asked int, rank int, score double, n long, node_type string, end_line long")


def tool_server(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the tool server to one request of each kind."""
    home = _folder(spark)
    with _home(home):
        repo, store = _project(spark, sf_dir, home), Store(spark, str(home / "store"))
        name, call = repo.name, lambda tool, **given: ("tools/call", {"name": tool, "arguments": given})
        requests = [
            ("initialize", {}), ("tools/list", {}), call("index", name=name), call("index", name=name, full=True), call("index", name="none"), call("search", name=name, query="x", limit=4), call("search", name=name, query="x", node_type="class"),
            call("search", name="none", query="x"), call("search", name=name), ("resources/list", {}), ("resources/templates/list", {}), ("resources/read", {"uri": "repos://list"}), ("resources/read", {"uri": f"repo://{name}/status"}), ("resources/read", {"uri": "repo://none/status"}),
            ("resources/read", {"uri": "x"}), ("prompts/list", {}), ("prompts/get", {"name": api.PROMPT}), ("ping", {}), ("nothing", {}),
        ]
        lines = [json.dumps({"jsonrpc": "2.0", "id": i, "method": m, "params": p}) for i, (m, p) in enumerate(requests)]
        out = io.StringIO()
        api.serve(store, io.StringIO("\n".join([*lines, json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"}), "{broken"]) + "\n"), out)
    rows = []
    for line in out.getvalue().splitlines():
        a = json.loads(line)
        rows.append((a["id"], *_brief(a.get("result")), a.get("error", {}).get("code")))
    return spark.createDataFrame(rows, "id long, what string, n long, failed boolean, code long")


def _brief(result: dict | None) -> tuple[str | None, int | None, bool | None]:
    """What an answer holds, in short."""
    if result is None:
        return None, None, None
    if "structuredContent" in result:
        s = result["structuredContent"]
        return ("error" if "error" in s else "hits" if "results" in s else "index"), (s.get("count", s.get("nodes_added"))), result["isError"]
    if "contents" in result:
        s = json.loads(result["contents"][0]["text"])
        return ("repos", len(s), None) if isinstance(s, list) else ("error", None, None) if "error" in s else ("status", s["nodes_indexed"], None)
    key = next((k for k in ("serverInfo", "tools", "resources", "resourceTemplates", "prompts", "messages") if k in result), None)
    return key, len(result[key]) if isinstance(result.get(key), list) else None, None


def command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit codes and lines written by one call of each command."""
    home, rows = _folder(spark), []
    with _home(home):
        repo, store = _project(spark, sf_dir, home), Store(spark, str(home / "store"))
        (home / "plain").mkdir()
        os.environ["EDITOR"], editor = "true", os.environ.get("EDITOR")
        for words in (
            ["init", repo.path], ["init", str(home / "plain")], ["index", repo.name], ["index", repo.name], ["index", repo.name, "--full"], ["index", "none"], ["search", "run", repo.name, "--limit", "2"], ["search", "run", "none"], ["status"],
            ["config", "path"], ["config", "show"], ["config", "init"], ["config", "init"], ["config", "init", "--force"], ["config", "edit"], ["forget", repo.name], ["forget", repo.name], ["status"],
        ):
            out, err = io.StringIO(), io.StringIO()
            with contextlib.redirect_stdout(out), contextlib.redirect_stderr(err):
                code = cli.main(words, store)
            rows.append((len(rows), " ".join(w for w in words[:2] if w in ("init", "index", "search", "status", "forget", "config", "path", "show", "edit")), code, len(out.getvalue().splitlines()) if words[:2] != ["config", "show"] else 1, len(err.getvalue().splitlines())))
        os.environ.pop("EDITOR") if editor is None else os.environ.__setitem__("EDITOR", editor)
    return spark.createDataFrame(rows, "step long, command string, code long, lines long, errors long")


#: Files with faults: language, text, and the nodes (type, name) or the error that they give.
_FAULTS = (
    ("js", "export {}\n", None), ("ts", "function f() {}\nexport {};\n", None), ("json", '{"bad": , "good": {"k": {k}}}', (("object", "good"),)), ("json", "[1, 2", ()), ("json", '"{n}"', ()), ("yaml", "a: [", ()), ("toml", "= {k}\n[t{k}]\nx = 1\n", (("table", "t{k}"),)),
    ("md", "#No{k}\n##\n# {n}\n", (("Header 1", "{n}"),)), ("py", "def f{k}(:\n  pass\n\ndef g{k}():\n  pass\n", (("function", "f{k}"), ("function", "g{k}"))), ("css", ".a{k} { color: red", ()), ("html", "<p>{n}<h1></h1>", (("h1", "h1"),)), ("txt", "{n}", (("chunk", ""),)), ("rs", "// {n}\n", ()),
)


def parse_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with faults, as they are parsed and stored: their error is a row, and other files are none the worse."""
    out = None
    for i, (suffix, text, _) in enumerate(_FAULTS):
        part = _sources(spark, sf_dir, **{suffix: text}).withColumn("path", F.concat(F.lit(f"{i}/"), "path"))
        out = part if out is None else out.unionByName(part)
    nodes = parsers.nodes(out.withColumn("hash", F.lit("h")), "root")
    return nodes.select("document_path", "repo_path", "node_type", "node_name", "documentation", "signature", "parent_scope", F.col("error").isNotNull().alias("failed"), (F.col("start_line") > 0).alias("placed"))


def _faults_sql() -> str:
    fill = lambda x: f"replace(replace('{x}', '{{k}}', CAST(n_nationkey AS VARCHAR)), '{{n}}', n_name)"
    rows = []
    for i, (suffix, _, nodes) in enumerate(_FAULTS):
        for kind, name in (("unknown", ""),) if nodes is None else nodes:
            failed = nodes is None
            sign = "'def g' || CAST(n_nationkey AS VARCHAR) || '()'" if name == "g{k}" else "'def f' || CAST(n_nationkey AS VARCHAR) || '('" if name == "f{k}" else "''"
            rows.append(f"SELECT '{i}/{suffix}/f' || CAST(n_nationkey AS VARCHAR) || '.{suffix}' AS document_path, 'root' AS repo_path, '{kind}' AS node_type, {fill(name)} AS node_name, '' AS documentation, {sign} AS signature, '{"root" if name == "good" else ""}' AS parent_scope, {str(failed).lower()} AS failed, {str(not failed).lower()} AS placed FROM nation")
    return " UNION ALL ".join(rows)


def _values(columns: str, rows: list[tuple]) -> str:
    cell = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else f"'{x}'" if isinstance(x, str) and not x.startswith("=") else str(x).removeprefix("=")
    cast = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in (c.split() for c in columns.split(", ")))
    return f"SELECT {cast} FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) v({', '.join(c.split()[0] for c in columns.split(', '))})"


_PY, _JSON = (len(CASES[x][0].expected) for x in ("python", "json"))
_N = "(SELECT count(*) FROM nation)"
_ALL = f"={_PY + _JSON} * {_N}"

SQL = {
    "decoded_text": f"SELECT doc_id, CAST({_SIZE} AS BIGINT) AS size_bytes, sha256(text) AS text_hash FROM documents",
    "tree_scan": f"""SELECT path, CAST(size_bytes AS BIGINT) AS size_bytes, sha256(path || ':' || text) AS hash, sha256(text) AS text_hash FROM (SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, text, {_SIZE} AS size_bytes FROM documents UNION ALL {_beside_sql()})
      WHERE size_bytes BETWEEN 1 AND 240000""",
    "registry": """SELECT n_nationkey, n_name AS name, CASE n_nationkey % 4 WHEN 0 THEN 'InvalidGitRepositoryError' WHEN 1 THEN 'c_' || CAST(n_nationkey AS VARCHAR) ELSE 'nodelake_' || replace(lower(n_name), ' ', '_') END AS outcome, true AS same_again,
      CASE n_nationkey % 4 WHEN 0 THEN '-' ELSE 'RepoExistsError' END AS clash, CAST(CASE n_nationkey % 4 WHEN 1 THEN n_nationkey + 1 ELSE 500 END AS BIGINT) AS max_sync_files, CAST(CASE n_nationkey % 4 WHEN 2 THEN n_nationkey * 10 ELSE 10485760 END AS BIGINT) AS max_file_size,
      n_nationkey % 4 <> 0 AS listed, n_nationkey % 4 <> 0 AND n_nationkey % 3 <> 0 AS there_in_the_end, CAST(0 AS BIGINT) AS in_a_broken_file FROM nation""",
    "settings_layers": """SELECT r_regionkey, ['local', 'memory', 'remote', 'ValueError'][r_regionkey % 4 + 1] AS mode, CAST(CASE WHEN ok THEN 1000 + r_regionkey END AS BIGINT) AS port, CAST(CASE WHEN ok THEN r_regionkey + 1 END AS BIGINT) AS top_k, CASE WHEN ok THEN '127.0.0.1' END AS host,
      CASE WHEN ok THEN [r_name] END AS patterns, CASE WHEN ok THEN 'hashed' END AS model FROM (SELECT *, r_regionkey % 4 <> 3 AS ok FROM region)""",
    "store_modes": f"""SELECT mode, CAST(0 AS BIGINT) AS created, 3 * n AS upserted, 3 * n AS filled, n AS upserted_again, 3 * n AS filled_again, CAST(0 AS BIGINT) AS upserted_none, CAST(2 AS BIGINT) AS deleted_paths, 3 * n - 15 AS after_deletes, 3 * n - 12 AS after_compacting, CAST(0 AS BIGINT) AS dropped
      FROM (SELECT unnest(['local', 'memory', 'remote']) AS mode, {_N} AS n)""",
    "repo_index": _RUNS.format(py=_PY, json=_JSON),
    "embedded_letters": f"SELECT doc_id, {_LETTERS.format('x')} AS embedding FROM (SELECT doc_id, regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z]', '', 'g') AS x FROM documents)",
    "embedded_in_batches": "SELECT count(*) AS n, true AS within FROM documents",
    "repo_search": f"""WITH v AS (SELECT r_regionkey, {_LETTERS.format('lower(r_name)')} AS q, {_LETTERS.format('lower(n_name)')} AS d FROM region, nation),
      s AS (SELECT r_regionkey, list_sum(list_transform(range(1, 27), lambda i: q[i] * d[i])) / sqrt(list_sum(list_transform(q, lambda x: x * x)) * list_sum(list_transform(d, lambda x: x * x))) AS score FROM v),
      r AS (SELECT r_regionkey, round(score, 5) AS score, row_number() OVER (PARTITION BY r_regionkey ORDER BY score DESC) - 1 AS rank FROM s)
      SELECT r_regionkey, CAST(asked AS INT) AS asked, CAST(rank AS INT) AS rank, score, CAST(k AS BIGINT) AS n, 'Header 1' AS node_type, CAST(2 AS BIGINT) AS end_line FROM r, (VALUES (3, 3), (0, 10), (-1, 10)) l(asked, k) WHERE rank < k""",
    "tool_server": _values("id BIGINT, what VARCHAR, n BIGINT, failed BOOLEAN, code BIGINT", [
        (0, "serverInfo", None, None, None), (1, "tools", 2, None, None), (2, "index", _ALL, False, None), (3, "index", _ALL, False, None), (4, "error", None, True, None), (5, "hits", 4, False, None), (6, "hits", 10, False, None), (7, "error", None, True, None), (8, None, None, None, api.BAD_PARAMS),
        (9, "resources", 1, None, None), (10, "resourceTemplates", 1, None, None), (11, "repos", 1, None, None), (12, "status", _ALL, None, None), (13, "error", None, None, None), (14, None, None, None, api.BAD_PARAMS), (15, "prompts", 1, None, None), (16, "messages", 1, None, None), (17, None, None, None, None),
        (18, None, None, None, api.NO_METHOD), (None, None, None, None, api.PARSE_ERROR)]),
    "command_line": _values("step BIGINT, command VARCHAR, code BIGINT, lines BIGINT, errors BIGINT", [
        (0, "init", 0, 1, 0), (1, "init", 1, 0, 1), (2, "index", 0, 1, f"={_N}"), (3, "index", 0, 1, f"={_N}"), (4, "index", 0, 1, f"={_N}"), (5, "index", 1, 0, 1), (6, "search", 0, 2, 0), (7, "search", 1, 0, 1), (8, "status", 0, 1, 0), (9, "config path", 0, 1, 0), (10, "config show", 0, 1, 0),
        (11, "config init", 0, 1, 0), (12, "config init", 1, 0, 1), (13, "config init", 0, 1, 0), (14, "config edit", 0, 0, 0), (15, "forget", 0, 1, 0), (16, "forget", 1, 0, 1), (17, "status", 0, 0, 0)]),
    "parse_faults": _faults_sql(),
}


def queries() -> dict:
    return {name: globals()[name] for name in SQL}
