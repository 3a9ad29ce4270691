"""Deeply nested JSON as related flat rows.

Every object gets an identity from its content: objects are canonicalised and hashed from the leaves up, an object's
hash covering its own scalar properties and the hashes of the objects below it (a Merkle tree). Two tables come out:

* occurrences: one bridge row for each place where an object or fragment stands: record, path, ordinal, the path and
  identity of the enclosing case, and its own identity. No occurrence is lost, however often an object repeats.
* objects: each distinct object once, with its canonical content, found by identity. In it {"$": identity} stands for an
  object, names are sorted, those that begin with $ have another before it, and equal numbers are written alike.

Cases are what p4_found asks for. With every=True the other objects are rows too: the root (payload, request or
response) and each object that is a property's value or stands in another array (object). Otherwise these are written
out in the content of the object that holds them.

A record's JSON is read by one task and never held together with others, so a hot source needs no special care; the
objects table combines by identity before its shuffle.
"""

from __future__ import annotations

import hashlib
import json
import sys

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.jsons import NotJson, parse_strict

OCCURRENCE = (
    "record_source string, record_id long, entity string, path string, parent_path string, ordinal int, "
    "node_hash binary, parent_hash binary, content string"
)
_ARROW = pa.schema(
    [
        ("record_source", pa.string()),
        ("record_id", pa.int64()),
        ("entity", pa.string()),
        ("path", pa.string()),
        ("parent_path", pa.string()),
        ("ordinal", pa.int32()),
        ("node_hash", pa.binary()),
        ("parent_hash", pa.binary()),
        ("content", pa.string()),
    ]
)
CLAUSE_LISTS = frozenset({"must", "should", "mustNot", "clauses"})
_dump = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode


def _hash(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _key(name: str) -> str:
    """A property's name in canonical content, where a name of its own, "$", refers to an object: another $ goes before it."""
    return "$" + name if name.startswith("$") else name


def _scalar(v):
    """A scalar in canonical form: numbers that are equal look alike, whether written 1, 1.0 or 1e0."""
    return int(v) if isinstance(v, float) and v.is_integer() and abs(v) < 2**53 else v


class _Walk:
    """Collects the cases of one record. Subclasses say what a case is; keep() hashes what they find."""

    root = ""

    def __init__(self, source: str, record: int, every: bool = False):
        self.source, self.record, self.every, self.rows = source, record, every, []

    def inner(self, path: str, parent: int, ordinal: int, shape):
        """The form of an object that is no case: shape(row of its enclosing object), by hash if every object counts."""
        if not self.every:
            return shape(parent)
        at = self.open()
        return {"$": self.close(at, "object" if path else self.root, path, parent, ordinal, _dump(shape(at))).hex()}

    def open(self) -> int:
        """Reserve a row, so that a parent stands before its children."""
        self.rows.append(None)
        return len(self.rows) - 1

    def close(self, at: int, entity: str, path: str, parent: int, ordinal: int, content: str) -> bytes:
        h = _hash(content)
        self.rows[at] = [self.source, self.record, entity, path, parent, ordinal, h, content]
        return h

    def finished(self):
        """Rows with the path and identity of their parents, known only now that all are hashed."""
        for source, record, entity, path, parent, ordinal, h, content in self.rows:
            up = self.rows[parent] if parent >= 0 else None
            yield source, record, entity, path, up[3] if up else "", ordinal, h, up[6] if up else None, content


class _Payload(_Walk):
    """child: each object that is an element of an array, at any depth."""

    root = "payload"

    def value(self, v, path: str, parent: int, ordinal: int, element: bool):
        """A form of the value for its parent's content: scalars as they are, objects by hash."""
        if isinstance(v, dict):
            shape = lambda at: {_key(k): self.value(x, f"{path}/{k}", at, -1, False) for k, x in v.items()}
            if element:
                at = self.open()
                return {"$": self.close(at, "child", path, parent, ordinal, _dump(shape(at))).hex()}
            return self.inner(path, parent, -1, shape)
        if isinstance(v, list):
            return [self.value(x, f"{path}/{i}", parent, i, True) for i, x in enumerate(v)]
        return _scalar(v)


def _camel(name: str) -> str:
    return name[:1].lower() + name[1:]


def _listed(v) -> list:
    """An array's elements; a bare object or string in its place is element 0."""
    return v if isinstance(v, list) else [v] if isinstance(v, (dict, str)) else []


class _Request(_Walk):
    """clause: each query that is an element of must, should, mustNot or clauses, at any depth."""

    root = "request"

    def value(self, v, path: str, parent: int, ordinal: int = -1):
        if isinstance(v, dict):
            return self.inner(path, parent, ordinal, lambda at: self.shape(v, path, at))
        if isinstance(v, list):
            return [self.value(x, f"{path}/{i}", parent, i) for i, x in enumerate(v)]
        return _scalar(v)

    def shape(self, v: dict, path: str, at: int):
        shape = {}
        for name, x in v.items():
            k = _camel(name)
            if k in CLAUSE_LISTS:
                shape[k] = [self.clause(e, f"{path}/{k}/{i}", at, i) for i, e in enumerate(_listed(x))]
            else:
                shape[_key(k)] = self.value(x, f"{path}/{k}", at)
        return shape

    def clause(self, v, path: str, parent: int, ordinal: int):
        if not isinstance(v, dict):
            return self.value(v, path, parent)
        at = self.open()
        return {"$": self.close(at, "clause", path, parent, ordinal, _dump(self.shape(v, path, at))).hex()}


class _Response(_Walk):
    """hit: each element of hits; fragment: each string under highlights."""

    root = "response"

    def value(self, v):
        if isinstance(v, dict):
            self.inner("", -1, -1, lambda at: self.shape(v, at))

    def shape(self, v: dict, at: int):
        shape = {}
        for name, x in v.items():
            k = _camel(name)
            if k == "hits":
                shape[k] = [self.hit(hit, f"/hits/{i}", at, i) for i, hit in enumerate(_listed(x))]
            else:
                shape[_key(k)] = self.plain(x, f"/{k}", at)
        return shape

    def plain(self, v, path: str, parent: int, ordinal: int = -1):
        if not self.every:
            return v
        if isinstance(v, dict):
            return self.inner(path, parent, ordinal, lambda at: {_key(k): self.plain(x, f"{path}/{k}", at) for k, x in v.items()})
        if isinstance(v, list):
            return [self.plain(x, f"{path}/{i}", parent, i) for i, x in enumerate(v)]
        return _scalar(v)

    def hit(self, v, path: str, parent: int, ordinal: int):
        if v is None:
            return None
        at = self.open()
        shape = v
        if isinstance(v, dict):
            shape = {}
            for name, x in v.items():
                k = _camel(name)
                if k == "highlights" and isinstance(x, dict):
                    shape[k] = self.inner(f"{path}/{k}", at, -1, lambda up, x=x: self.fragments(x, f"{path}/highlights", up))
                else:
                    shape[k] = self.plain(x, f"{path}/{k}", at)
        return {"$": self.close(at, "hit", path, parent, ordinal, _dump(shape)).hex()}

    def fragments(self, v: dict, path: str, parent: int):
        shape = {}
        for field, x in v.items():
            shape[field] = []
            for i, s in enumerate(_listed(x)):
                if isinstance(s, str):
                    at = self.open()
                    shape[field].append({"$": self.close(at, "fragment", f"{path}/{field}/{i}", parent, i, _dump(s)).hex()})
                else:
                    shape[field].append(self.plain(s, f"{path}/{field}/{i}", parent, i))
        return shape


def _payload(every: bool):
    def rows(record: int, text: str):
        walk = _Payload("bulk", record, every)
        walk.value(parse_strict(text), "", -1, -1, False)
        return walk.finished()

    return rows


def _search(kind, every: bool):
    def rows(record: int, text: str):
        v = parse_strict(text)
        while isinstance(v, str):  # a body that was encoded twice counts as the inner one
            v = parse_strict(v)
        walk = kind("search", record, every)
        walk.value(v, "", -1) if kind is _Request else walk.value(v)
        return walk.finished()

    return rows


def _batches(readers):
    """A mapInArrow function over (id, one or more JSON columns); each column has its reader. Output is cut in blocks."""

    def run(batches):
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 60_000))  # a few frames for each level that the decoder takes
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: list[tuple] = []
            for reader, column in zip(readers, batch.columns[1:]):
                for record, text in zip(ids, column.to_pylist()):
                    if record is None or text is None:
                        continue
                    try:
                        out.extend(reader(record, text))
                    except (NotJson, RecursionError):
                        continue
                    if len(out) >= 20_000:
                        yield _table(out)
                        out = []
            if out:
                yield _table(out)

    return run


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


def payload_occurrences(operations: DataFrame, every: bool = False) -> DataFrame:
    """Occurrences of the objects in arrays of bulk_operations.document_json; record_id is the delivery_id.

    A null, blank, damaged or scalar payload, or one without a delivery_id, gives no rows. A delivery_id is unique
    by contract; if one repeats, its occurrences repeat with it. Paths keep property names as they are.
    """
    texts = operations.where(F.col("document_json").contains("{" if every else "[")).select("delivery_id", "document_json")
    return texts.mapInArrow(_batches([_payload(every)]), OCCURRENCE)


def search_occurrences(searches: DataFrame, every: bool = False) -> DataFrame:
    """Occurrences of clauses, hits and highlight fragments of search_log; record_id is the search_id.

    Contract names are taken in camelCase and PascalCase. Missing, damaged or cut bodies give nothing. A row that
    stands twice gives its occurrences twice.
    """
    return searches.select("search_id", "request_json", "response_json").mapInArrow(_batches([_search(_Request, every), _search(_Response, every)]), OCCURRENCE)


def nested_cases(operations: DataFrame, searches: DataFrame) -> DataFrame:
    """(record_source, record_id, entity, path, parent_path): each case of both sources once."""
    columns = ["record_source", "record_id", "entity", "path", "parent_path"]
    # copies of a search are only removed once flat: its rows are far smaller than its JSON
    return payload_occurrences(operations).select(*columns).unionByName(search_occurrences(searches).select(*columns).distinct())


def all_occurrences(operations: DataFrame, searches: DataFrame) -> DataFrame:
    """Every object and fragment of both sources, a search that stands twice counting once."""
    place = ["record_source", "record_id", "entity", "path", "parent_path", "ordinal", "node_hash", "parent_hash"]
    return payload_occurrences(operations, every=True).unionByName(search_occurrences(searches, every=True).dropDuplicates(place))


def object_store(occurrences: DataFrame) -> DataFrame:
    """(node_hash, entities, content, occurrences): each distinct object once; entities names what it occurs as."""
    # a handful of names at most
    entities = F.array_join(F.array_sort(F.collect_set("entity")), " ")
    return occurrences.groupBy("node_hash").agg(entities.alias("entities"), F.min("content").alias("content"), F.count("*").alias("occurrences"))
