"""The tools over standard input and output: JSON-RPC 2.0, a message on each line, as agents speak it to local tool servers."""

from __future__ import annotations

import inspect
import json
from collections.abc import Iterator
from typing import IO

from arbora.tools import Service

#: The protocol's version, and the error codes of JSON-RPC.
PROTOCOL = "2025-06-18"
PARSE, METHOD, PARAMS = -32700, -32601, -32602
_KINDS = {"str": "string", "int": "integer", "bool": "boolean"}
#: What each tool is for.
TOOLS = {
    "artifact_inspect": "Read a file into a document tree and summarise it.",
    "artifact_inspect_resource": "Read a file that another one holds, and summarise it.",
    "artifact_find": "Find the nodes that hold every word of a query, best first.",
    "artifact_read": "Read a window of a node's text or of a resource's bytes.",
    "artifact_extract_table": "Read a window of a table's rows.",
    "artifact_list_attachments": "List what a document holds.",
    "artifact_list_files": "List the files of a folder within the roots.",
    "artifact_get_provenance": "Tell where a node stands, from the root down.",
    "artifact_formats": "List the formats that can be read.",
}


def described() -> list[dict]:
    """Names, purposes and input schemas of the tools, from the functions' own signatures."""
    out = []
    for name, purpose in TOOLS.items():
        parameters = list(inspect.signature(getattr(Service, name)).parameters.values())[1:]
        schema = {"type": "object", "properties": {p.name: {"type": _KINDS[p.annotation]} for p in parameters}, "required": [p.name for p in parameters if p.default is p.empty], "additionalProperties": False}
        out.append({"name": name, "description": purpose, "inputSchema": schema, "annotations": {"readOnlyHint": True}})
    return out


def _called(service: Service, params: dict) -> dict:
    name, arguments = params.get("name"), params.get("arguments") or {}
    if name not in TOOLS:
        raise LookupError(f"unknown tool {name}")
    try:
        inspect.signature(getattr(Service, name)).bind(service, **arguments)
    except TypeError as e:
        raise LookupError(str(e)) from None
    try:
        found = getattr(service, name)(**arguments)
    except Exception as e:  # noqa: BLE001  the caller is told, the server goes on
        return {"content": [{"type": "text", "text": str(e) or type(e).__name__}], "isError": True}
    structured = found if isinstance(found, dict) else {"items": found}
    text = json.dumps(structured, ensure_ascii=False, default=str)
    return {"content": [{"type": "text", "text": text}], "structuredContent": json.loads(text), "isError": False}


def answer(service: Service, version: str, message: object) -> dict | None:
    """The reply to one message; none to a notification."""
    if not isinstance(message, dict) or message.get("jsonrpc") != "2.0" or not isinstance(message.get("method"), str):
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "not a request"}}
    if "id" not in message:
        return None
    out = {"jsonrpc": "2.0", "id": message["id"]}
    method, params = message["method"], message.get("params") or {}
    if method == "initialize":
        return out | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "arbora", "version": version}}}
    if method == "ping":
        return out | {"result": {}}
    if method == "tools/list":
        return out | {"result": {"tools": described()}}
    if method == "tools/call":
        try:
            return out | {"result": _called(service, params)}
        except LookupError as e:
            return out | {"error": {"code": PARAMS, "message": str(e.args[0])}}
    return out | {"error": {"code": METHOD, "message": f"unknown method {method}"}}


def replies(service: Service, version: str, lines: Iterator[str]) -> Iterator[dict]:
    for line in lines:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
        except ValueError as e:
            yield {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE, "message": str(e)}}
            continue
        if (reply := answer(service, version, message)) is not None:
            yield reply


def serve(service: Service, version: str, source: IO[str], target: IO[str]) -> None:
    """Answer until the input ends."""
    for reply in replies(service, version, source):
        target.write(json.dumps(reply, ensure_ascii=False) + "\n")
        target.flush()
