"""Deeply nested ticket payloads to flat, linked tables.

One pass: every payload is parsed once and a depth-first visitor emits rows tagged with their table, their own key,
the key of the node that holds them and their payload. :func:`tables` stores the stream once, partitioned by tag, and
reads each table from its own part with its typed columns. Nothing is shuffled and no group is gathered.

Keys: (``file_id``, ``ord``) is a node's own key, ``ord`` its place in the walk of its file; (``file_id``,
``parent_ord``) is its parent's, null below the root. They hold where ids of the source are missing or repeated; the
ids are kept beside them as ``node_id`` and ``parent_id``.

Defined cases: a null, blank or non-JSON payload gives no rows; leading byte-order marks and blanks are skipped; an
array may also stand as null, as an object wrapping ``items``, as a single object, as a map of objects or as a string
holding JSON; entries that are not objects are skipped, an empty object standing for a list is an empty list; an
object without id has a null ``node_id`` and so have its children a null ``parent_id``, while their ``parent_ord`` is
set; repeated ids give rows that ``ord`` tells apart; nesting of any depth is followed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskmill.session import materialise

NODE_SCHEMA = "file_id BIGINT, kind STRING, node_id STRING, parent_id STRING, depth INT, ord BIGINT, parent_ord BIGINT, payload STRING"

#: Typed columns of each table, as paths into the emitted payload.
TABLE_SCHEMAS = {
    "comment": "cmf_created_at STRING, author_role STRING, cmf_owner_id STRING, body STRING",
    "reply": "cmf_created_at STRING, author_role STRING, cmf_owner_id STRING, body STRING",
    "attachment": "name STRING, size STRING, mime STRING, pages INT",
}

_LEADING = "\ufeff\u200b\u2060\x00 \t\r\n\x0b\x0c\x85\xa0"
_ATOM = re.compile(r"[ \t\r\n]*(?:([{}\[\],:])|(\")|(-?\d[\d.eE+-]*|true|false|null|NaN|-?Infinity))")


def _parse_flat(text: str):
    """JSON parser with its own stack, for nesting that exhausts the recursive one. ValueError where it isn't JSON."""
    stack, keys, pos, want, n = [], [], 0, "value", len(text)
    root = None
    while True:
        m = _ATOM.match(text, pos)
        if not m:
            raise ValueError("not JSON")
        mark, pos, done = m[1], m.end(), False
        if mark in ("{", "[") and want in ("value", "value or ]"):
            stack.append({} if mark == "{" else [])
            keys.append(None)
            want = "key or }" if mark == "{" else "value or ]"
            continue
        if mark == "}" and want in ("key or }", "next") and isinstance(stack[-1], dict):
            value, done = stack.pop(), True
            keys.pop()
        elif mark == "]" and want in ("value or ]", "next") and isinstance(stack[-1], list):
            value, done = stack.pop(), True
            keys.pop()
        elif mark == "," and want == "next":
            want = "key" if isinstance(stack[-1], dict) else "value"
            continue
        elif m[2] and want in ("key", "key or }"):
            keys[-1], pos = scanstring(text, pos)
            colon = _ATOM.match(text, pos)
            if not colon or colon[1] != ":":
                raise ValueError("not JSON")
            pos, want = colon.end(), "value"
            continue
        elif m[2] and want in ("value", "value or ]"):
            value, pos = scanstring(text, pos)
            done = True
        elif m[3] and want in ("value", "value or ]"):
            value, done = json.loads(m[3]), True
        if not done:
            raise ValueError("not JSON")
        if not stack:
            root = value
            if text[pos:].strip(" \t\r\n"):
                raise ValueError("not JSON")
            return root
        if isinstance(stack[-1], dict):
            stack[-1][keys[-1]] = value
        else:
            stack[-1].append(value)
        want = "next"


def parse_payload(text: str | None):
    """The payload's value, or None where it isn't JSON."""
    if text is None:
        return None
    text = text.lstrip(_LEADING)
    if not text:
        return None
    try:
        return json.loads(text)
    except RecursionError:
        try:
            return _parse_flat(text)
        except ValueError:
            return None
    except ValueError:
        return None


def as_objects(value) -> list[dict]:
    """The objects of what stands for a list."""
    if isinstance(value, str):
        value = parse_payload(value)
    if isinstance(value, list):
        return [x for x in value if isinstance(x, dict)]
    if isinstance(value, dict) and value:
        if "items" in value and "id" not in value:
            return as_objects(value["items"])
        if "id" not in value and all(isinstance(x, dict) for x in value.values()):
            return list(value.values())
        return [value]
    return []


def id_text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False)


def visit(text: str | None) -> Iterator[tuple[str, str | None, str | None, int, int, int | None, dict]]:
    """(kind, node_id, parent_id, depth, ord, parent_ord, own fields) of each node, depth first, without recursion."""
    ticket = parse_payload(text)
    ticket = ticket.get("result") if isinstance(ticket, dict) else None
    if isinstance(ticket, list):
        ticket = ticket[0] if ticket else None
    if not isinstance(ticket, dict):
        return
    stack = [("comment", "root", None, 0, x) for x in reversed(as_objects(ticket.get("comments_list")))]
    at = -1
    while stack:
        kind, parent, above, depth, node = stack.pop()
        own, at = id_text(node.get("id")), at + 1
        yield kind, own, parent, depth, at, above, {k: v for k, v in node.items() if k not in ("replies", "attachments")}
        if kind != "attachment":
            stack += [("reply", own, at, depth + 1, x) for x in reversed(as_objects(node.get("replies")))]
            stack += [("attachment", own, at, depth + 1, x) for x in reversed(as_objects(node.get("attachments")))]


def flatten(files: DataFrame, id_col: str = "file_id", payload_col: str = "payload", with_payload: bool = True) -> DataFrame:
    """Tagged rows of every node below ``comments_list``; other columns of ``files`` are not read."""

    def emit(batches):
        for batch in batches:
            out: list[tuple] = []
            for file_id, text in zip(batch["file_id"], batch["payload"]):
                for *keys, fields in visit(text):
                    out.append((file_id, *keys, json.dumps(fields, ensure_ascii=False) if with_payload else None))
            frame = pd.DataFrame(out, columns=["file_id", "kind", "node_id", "parent_id", "depth", "ord", "parent_ord", "payload"])
            yield frame.astype({"parent_ord": "Int64"})

    return files.select(F.col(id_col).alias("file_id"), F.col(payload_col).alias("payload")).mapInPandas(emit, NODE_SCHEMA)


def tables(files: DataFrame, id_col: str = "file_id", payload_col: str = "payload") -> dict[str, DataFrame]:
    """The typed table of each tag, all from one written stream with one folder per tag, so that a reader of one table never opens the others."""
    stream = materialise(flatten(files, id_col, payload_col), "nodes", by="kind")
    return {kind: apply_schema(stream, kind) for kind in TABLE_SCHEMAS}


def apply_schema(nodes: DataFrame, kind: str) -> DataFrame:
    """The typed table of one tag. Fields of changing type are read as a variant, so a cast that fails gives null."""
    v = F.try_parse_json("payload")
    base = nodes.filter(F.col("kind") == kind)
    keys = ["file_id", "node_id", "parent_id", "depth", "ord", "parent_ord"]
    if kind == "attachment":
        return base.select(
            *keys,
            F.try_variant_get(v, "$.name", "string").alias("name"),
            F.try_variant_get(v, "$.size", "string").alias("size"),
            F.try_variant_get(v, "$.meta.mime", "string").alias("mime"),
            F.size(F.try_variant_get(v, "$.meta.pages", "array<variant>")).alias("pages"),
        )
    text = lambda key: F.coalesce(
        F.try_variant_get(v, f"$.{key}.text", "string"), F.try_variant_get(v, f"$.{key}.html", "string"),
        F.when(~F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant")).startswith("OBJECT"), F.try_variant_get(v, f"$.{key}", "string")),
    )
    owner = F.try_variant_get(v, "$.cmf_owner_id", "variant")
    return base.select(
        *keys,
        F.try_variant_get(v, "$.cmf_created_at", "string").alias("cmf_created_at"),
        F.try_variant_get(v, "$.author_role", "string").alias("author_role"),
        F.coalesce(F.try_variant_get(v, "$.cmf_owner_id.id", "string"), F.when(~F.schema_of_variant(owner).startswith("OBJECT"), F.try_variant_get(v, "$.cmf_owner_id", "string"))).alias("cmf_owner_id"),
        F.coalesce(text("text"), text("content")).alias("body"),
    )
