"""Columnar shredding of nested JSON records with repetition and definition levels (problem 6).

Every leaf path of a record becomes a column of (repetition level, definition level, value) entries, in the way
columnar file formats store nested data. Tables per repeated ancestor are then rebuilt from the level sequences
alone: an entry with repetition level r starts a new element of the r-th repeated ancestor, so counting levels gives
the index vector of every element, and the index vectors give parent-child links and written order. All of it
happens inside one pass over the partition; no shuffle is needed and no record meets another.

Varying shapes are brought into the declared schema first: a single object or scalar stands for a list of one, a
delimited string for a list of names, an object keyed by code for a list of (code, value) objects. Groups of countries
may nest to any depth and wrappers around a record may be any number: the schema of the country groups is read from the
record itself, so a path that a record does not have gets no column.

Defined results: a null, blank, damaged or non-object payload yields no row; a repeated record yields its rows again
under its own id; a record without the field yields no child row; entries that are null, blank or marked as not
available are left out and do not count in the ordinal; an empty input yields an empty table; extra columns of the
input are not looked at.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

#: Words by which a value says that it is absent.
NOT_AVAILABLE = frozenset({"", "n/a", "na", "n.a.", "none", "null", "nan", "-", "--", "not available", "not reported", "not_reported", "not_available", "unknown", "?"})


@dataclass(frozen=True)
class Node:
    """A field of the declared schema: a leaf (no children) or a group, repeated or optional."""

    name: str
    repeated: bool = False
    children: tuple["Node", ...] = field(default=())
    adapt: Callable[[object], object] | None = None


def available(value: object) -> bool:
    return value is not None and not (isinstance(value, str) and value.strip().lower() in NOT_AVAILABLE)


def read_payload(text: str | None) -> dict | None:
    """The record in a payload: byte order mark, string-in-string, list-of-one and single-key wrappers removed."""
    if text is None:
        return None
    node: object = text
    while True:  # every step leaves a smaller value
        if isinstance(node, str):
            try:
                node = json.loads(node.lstrip("\ufeff").strip())
            except (ValueError, RecursionError):
                return None
        elif isinstance(node, list):
            node = next((x for x in node if isinstance(x, (dict, str))), None)
        elif isinstance(node, dict):
            if "metadata" in node or "data" in node and isinstance(node["data"], dict) and "metadata" not in node["data"]:
                return node
            inner = [v for v in node.values() if isinstance(v, (dict, list)) or isinstance(v, str) and v.lstrip().startswith("{")]
            if len(inner) != 1:
                return node
            node = inner[0]
        else:
            return None


def shred(value: object, node: Node, path: str = "", rep: int = 0, depth_rep: int = 0, depth_def: int = 0, out: dict | None = None) -> dict[str, list[tuple[int, int, object]]]:
    """The columns of one record: leaf path -> entries (repetition level, definition level, value)."""
    out = {} if out is None else out
    where = f"{path}.{node.name}" if path else node.name
    value = _decoded(value) if node.children or node.repeated else value
    if node.adapt is not None:
        value = node.adapt(value) if available(value) else None
    if node.repeated:
        items = value if isinstance(value, list) else ([] if value is None else [value])
        if not items:
            _absent(node, path, rep, depth_def, out)
        for k, item in enumerate(items):
            _element(item, node, where, rep if k == 0 else depth_rep + 1, depth_rep + 1, depth_def + 1, out)
    elif value is None:
        _absent(node, path, rep, depth_def, out)
    else:
        _element(value, node, where, rep, depth_rep, depth_def + 1, out)
    return out


def _decoded(value: object) -> object:
    """A list or object that was written as a string is read; any other value stays."""
    if isinstance(value, str) and value.lstrip()[:1] in ("{", "["):
        try:
            return json.loads(value)
        except ValueError:
            return value
    return value


def _element(value: object, node: Node, where: str, rep: int, depth_rep: int, depth_def: int, out: dict) -> None:
    if not node.children:
        out.setdefault(where, []).append((rep, depth_def, value))
        return
    for child in node.children:
        shred(value.get(child.name) if isinstance(value, dict) else None, child, where, rep, depth_rep, depth_def, out)


def _absent(node: Node, path: str, rep: int, depth_def: int, out: dict) -> None:
    where = f"{path}.{node.name}" if path else node.name
    if not node.children:
        out.setdefault(where, []).append((rep, depth_def, None))
    for child in node.children:
        _absent(child, where, rep, depth_def, out)


def repeated_depth(root: Node, leaf_path: str) -> tuple[int, int]:
    """(highest repetition level, highest definition level) of a leaf path."""
    parts, node, rep, deep = leaf_path.split("."), root, 0, 0
    for k, part in enumerate(parts):
        node = node if k == 0 else next(c for c in node.children if c.name == part)
        rep, deep = rep + node.repeated, deep + 1
    return rep, deep


def index_vectors(entries: list[tuple[int, int, object]], levels: int) -> list[tuple[int, ...]]:
    """The 1-based index of every entry's element at each repeated ancestor, from the level sequence."""
    at, out = [0] * levels, []
    for rep, _, _ in entries:
        if rep == 0:
            at = [1] * levels
        else:
            at = [*at[: rep - 1], at[rep - 1] + 1, *([1] * (levels - rep))]
        out.append(tuple(at))
    return out


def assemble(columns: dict[str, list], root: Node, leaves: list[str]) -> list[tuple[tuple[int, ...], dict[str, object]]]:
    """The rows of the table of one repeated ancestor: (index vector, leaf name -> value), leaves of equal index joined."""
    rows: dict[tuple[int, ...], dict[str, object]] = {}
    for leaf in leaves:
        levels, deep = repeated_depth(root, leaf)
        for index, (_, definition, value) in zip(index_vectors(columns.get(leaf, []), levels), columns.get(leaf, []), strict=True):
            if definition == deep or definition >= deep - 1:
                rows.setdefault(index, {})[leaf.rpartition(".")[2]] = value if definition == deep else None
    return sorted(rows.items())


# The article record: authors, countries and the weighting text in every shape in which they occur


def _names(value: object) -> object:
    """A list of {name} objects from a list, an object or a string of names divided by semicolons."""
    if isinstance(value, str):
        value = value.split(";")
    items = value if isinstance(value, list) else [value]
    out = []
    for item in items:
        name = item.get("name", item) if isinstance(item, dict) else item
        if isinstance(name, dict):
            name = " ".join(str(name[k]).strip() for k in ("given", "middle", "family") if available(name.get(k)))
        elif isinstance(name, str) and name.count(",") == 1:
            family, given = name.split(",")
            name = f"{given.strip()} {family.strip()}"
        out.append({"name": name.strip() if isinstance(name, str) else None})
    return out


def _countries(value: object) -> object:
    """A list of country or group objects; codes alone and objects keyed by code become country objects."""
    if isinstance(value, str):
        value = re.split(r"[;,]", value)
    if isinstance(value, dict) and value and not {"country_code", "countries", "subgroups"} & value.keys():
        value = [{"country_code": k, "n_students": v} for k, v in value.items()]
    items = value if isinstance(value, list) else [value]
    return [x if isinstance(x, dict) else {"country_code": x} if isinstance(x, str) else None for x in items if x is not None]


def _texts(value: object) -> object:
    if isinstance(value, dict):
        value = list(value.values())
    return value if isinstance(value, list) else [value]


#: The nesting of country groups found in a record: (name of the inner list, its own shape) pairs.
Shape = tuple[tuple[str, "Shape"], ...]
_INNER = {"countries": _countries, "subgroups": None}


def group_shape(items: object) -> Shape:
    """How deep and under which names the country groups of a list nest; level by level, so no depth is too deep."""
    paths: set[tuple[str, ...]] = set()
    level: list[tuple[tuple[str, ...], object]] = [((), items)]
    while level:
        deeper = []
        for path, value in level:
            for item in value if isinstance(value, list) else ():
                for name, adapt in _INNER.items() if isinstance(item, dict) else ():
                    inner = _decoded(item.get(name))
                    if available(inner):
                        inner = adapt(inner) if adapt else inner if isinstance(inner, list) else [inner]
                        paths.add((*path, name))
                        deeper.append(((*path, name), inner))
        level = deeper
    tree: dict = {}
    for path in sorted(paths):
        at = tree
        for name in path:
            at = at.setdefault(name, {})
    return _frozen(tree)


def _frozen(tree: dict) -> Shape:
    return tuple((name, _frozen(inner)) for name, inner in sorted(tree.items()))


def _country_nodes(shape: Shape) -> tuple[Node, ...]:
    leaves = (Node("country_code"), Node("n_students"))
    return leaves + tuple(Node(name, True, _country_nodes(inner), _INNER[name]) for name, inner in shape)


@lru_cache(maxsize=4096)
def article(shape: Shape = ()) -> Node:
    """The schema of an article record whose country groups have this shape."""
    return Node(
        "record",
        children=(
            Node("metadata", children=(Node("authors", True, (Node("name"),), _names),)),
            Node(
                "data",
                children=(
                    Node("survey_design", children=(Node("weight_fields_interpretation", True, (), _texts),)),
                    Node("sample_details", children=(Node("countries", True, _country_nodes(shape), _countries),)),
                ),
            ),
        ),
    )


def article_of(record: dict) -> Node:
    """The schema of one record: its country groups as deep as they go."""
    data = _decoded(record.get("data"))
    sample = _decoded(data.get("sample_details")) if isinstance(data, dict) else None
    listed = _decoded(sample.get("countries")) if isinstance(sample, dict) else None
    return article(group_shape(_countries(listed)) if available(listed) else ())


def leaf_paths(node: Node, path: str = "") -> list[str]:
    where = f"{path}.{node.name}" if path else node.name
    return [where] if not node.children else [x for c in node.children for x in leaf_paths(c, where)]


@lru_cache(maxsize=4096)
def _column_groups(root: Node) -> dict[str, list[str]]:
    """Repeated ancestor -> its leaf paths."""
    groups: dict[str, list[str]] = {}
    for leaf in leaf_paths(root):
        groups.setdefault(leaf.rpartition(".")[0] if leaf.rpartition(".")[2] in ("country_code", "n_students", "name") else leaf, []).append(leaf)
    return groups


_PREFIX = {"authors": "record.metadata.authors", "countries": "record.data.sample_details.countries", "weight_fields_interpretation": "record.data.survey_design.weight_fields_interpretation"}


def article_rows(payload: str | None) -> list[tuple[str, int, str]]:
    """(leaf path, ordinal, value) rows of an article record, rebuilt from its shredded columns."""
    record = read_payload(payload)
    if record is None:
        return []
    root = article_of(record)
    columns = shred(record, root)
    out: list[tuple[str, int, str]] = []
    for field_name, prefix in _PREFIX.items():
        found: list[tuple[tuple[int, ...], dict[str, object]]] = []
        for ancestor, leaves in _column_groups(root).items():
            if ancestor == prefix or ancestor.startswith(prefix + "."):
                found += assemble(columns, root, leaves)
        found.sort(key=lambda x: x[0])
        ordinal = 0
        for _, row in found:
            key = row.get("country_code") if field_name == "countries" else next(iter(row.values()), None)
            if not isinstance(key, (str, int, float)) or not available(key):
                continue
            ordinal += 1
            if field_name != "countries":
                out.append((field_name, ordinal, str(key).strip()))
                continue
            out.append(("countries.country_code", ordinal, str(key).strip()))
            n = row.get("n_students")
            digits = re.sub(r"\D", "", str(int(n)) if isinstance(n, float) else str(n)) if available(n) and not isinstance(n, bool) else ""
            if digits:
                out.append(("countries.n_students", ordinal, digits))
    return out


def article_children(df: DataFrame, key: str = "record_id", payload: str = "payload") -> DataFrame:
    """Flat child rows (key, leaf_path, ordinal, leaf_value) of article records; see the module's text for edge cases."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *row) for k, text in zip(batch["k"], batch["p"], strict=True) for row in article_rows(text)]
            yield pd.DataFrame(rows, columns=["record_id", "leaf_path", "ordinal", "leaf_value"]).astype({"record_id": "int64", "ordinal": "int32"})

    return df.selectExpr(f"`{key}` as k", f"`{payload}` as p").where("p is not null and k is not null").mapInPandas(run, "record_id bigint, leaf_path string, ordinal int, leaf_value string")


def article_levels(df: DataFrame, key: str = "record_id", payload: str = "payload") -> DataFrame:
    """The shredded columns themselves: (key, leaf_path, entry_no, rep_level, def_level, leaf_value)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, text in zip(batch["k"], batch["p"], strict=True):
                record = read_payload(text)
                if record is None:
                    continue
                for leaf, entries in shred(record, article_of(record)).items():
                    rows += [(k, leaf, i, r, d, None if v is None else v if isinstance(v, str) else json.dumps(v)) for i, (r, d, v) in enumerate(entries, 1)]
            yield pd.DataFrame(rows, columns=["record_id", "leaf_path", "entry_no", "rep_level", "def_level", "leaf_value"]).astype({"record_id": "int64", "entry_no": "int32", "rep_level": "int32", "def_level": "int32"})

    return df.selectExpr(f"`{key}` as k", f"`{payload}` as p").where("p is not null and k is not null").mapInPandas(run, "record_id bigint, leaf_path string, entry_no int, rep_level int, def_level int, leaf_value string")
