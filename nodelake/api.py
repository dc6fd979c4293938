"""What a tool client gets: plain dictionaries and JSON texts, and a server that hands them out.

The server speaks JSON-RPC 2.0, one message a line, with the methods of the Model Context Protocol for tools, resources and
prompts."""

from __future__ import annotations

import json
from typing import IO, Any

from .config import Settings
from .errors import RepoNotFoundError
from .functions import scalars as X
from .operators.store import Store
from .service import Repo


def _missing(name: str, error: Exception) -> dict:
    return {"error": "repository_not_found", "message": str(error), "name": name}


def index(store: Store, name: str, full: bool = False) -> dict:
    try:
        return Repo.get(name).index(store, full).to_dict()
    except RepoNotFoundError as e:
        return _missing(name, e)


def search(store: Store, name: str, query: str, limit: int | None = None, **conditions) -> dict:
    try:
        k = X.effective_limit(limit, Settings.load().server["default_top_k"])
        hits = [r.asDict() for r in Repo.get(name).search(store, query, k, **conditions).collect()]
        return {"results": hits, "count": len(hits)}
    except RepoNotFoundError as e:
        return _missing(name, e)


def repos() -> str:
    return json.dumps([{"name": r.name, "path": r.path, "collection_name": r.collection_name} for r in Repo.list()], indent=2)


def status(store: Store, name: str) -> str:
    try:
        return json.dumps(Repo.get(name).status(store), indent=2)
    except RepoNotFoundError as e:
        return json.dumps(_missing(name, e), indent=2)


def search_prompt() -> str:
    """How to go about searching a repository."""
    return "\n".join((
        "1. List the repositories and pick one; look at its status.", "2. If documents are stale, index it; unchanged files cost little.",
        "3. Search with a plain description. Narrow by language, node_type, node_name, has_documentation,", "   or file_path (a directory if it ends in /).", "4. Read the files that the hits name before drawing conclusions.",
    ))


_TEXT, _NAME = {"type": "string"}, {"name": {"type": "string"}}
_CONDITIONS = {**dict.fromkeys(("file_path", "language", "node_type", "node_name"), _TEXT), "has_documentation": {"type": "boolean"}}
TOOLS = {
    "index": ("Bring a repository's index in step with its files.", _NAME | {"full": {"type": "boolean"}}, ["name"]),
    "search": ("Search a repository's nodes.", _NAME | {"query": _TEXT, "limit": {"type": "integer"}} | _CONDITIONS, ["name", "query"]),
}
REPOS, STATUS, PROMPT = "repos://list", "repo://{name}/status", "search_workflow"


def _call(store: Store, name: str, given: dict[str, Any]) -> dict:
    run = {"index": index, "search": search}[name]
    _, known, needed = TOOLS[name]
    if missing := [k for k in needed if k not in given]:
        raise TypeError(f"missing {', '.join(missing)}")
    if unknown := sorted(set(given) - set(known)):
        raise TypeError(f"unknown {', '.join(unknown)}")
    return run(store, **given)


def _read(store: Store, uri: str) -> str:
    if uri == REPOS:
        return repos()
    head, tail = STATUS.split("{name}")
    if uri.startswith(head) and uri.endswith(tail):
        return status(store, uri[len(head) : len(uri) - len(tail)])
    raise KeyError(uri)


def answer(store: Store, method: str, params: dict[str, Any]) -> dict:
    """The result of one request."""
    if method == "initialize":
        return {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}, "resources": {}, "prompts": {}}, "serverInfo": {"name": "nodelake", "version": "0.1.0"}}
    if method == "ping":
        return {}
    if method == "tools/list":
        return {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r) in TOOLS.items()]}
    if method == "tools/call":
        out = _call(store, params["name"], params.get("arguments") or {})
        return {"content": [{"type": "text", "text": json.dumps(out)}], "structuredContent": out, "isError": "error" in out}
    if method == "resources/list":
        return {"resources": [{"uri": REPOS, "name": "repositories", "mimeType": "application/json"}]}
    if method == "resources/templates/list":
        return {"resourceTemplates": [{"uriTemplate": STATUS, "name": "status", "mimeType": "application/json"}]}
    if method == "resources/read":
        return {"contents": [{"uri": params["uri"], "mimeType": "application/json", "text": _read(store, params["uri"])}]}
    if method == "prompts/list":
        return {"prompts": [{"name": PROMPT, "description": "How to search a repository"}]}
    if method == "prompts/get":
        if params["name"] != PROMPT:
            raise KeyError(params["name"])
        return {"messages": [{"role": "user", "content": {"type": "text", "text": search_prompt()}}]}
    raise NotImplementedError(method)


#: JSON-RPC's error codes.
PARSE_ERROR, NO_METHOD, BAD_PARAMS, FAILED = -32700, -32601, -32602, -32603


def respond(store: Store, line: str) -> str | None:
    """The answer to one message; none to a notification."""
    try:
        message = json.loads(line)
        method, params, id = message["method"], message.get("params") or {}, message.get("id")
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": str(e)}})
    if "id" not in message:
        return None
    try:
        return json.dumps({"jsonrpc": "2.0", "id": id, "result": answer(store, method, params)})
    except Exception as e:  # one request's error is its answer
        code = NO_METHOD if isinstance(e, NotImplementedError) else BAD_PARAMS if isinstance(e, (KeyError, TypeError)) else FAILED
        return json.dumps({"jsonrpc": "2.0", "id": id, "error": {"code": code, "message": str(e)}})


def serve(store: Store, requests: IO[str], answers: IO[str]) -> None:
    """Answer requests until there are no more."""
    for line in requests:
        if line.strip() and (out := respond(store, line)) is not None:
            answers.write(out + "\n")
            answers.flush()
