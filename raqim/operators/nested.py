"""Deeply nested JSON records as flat tables with parent-child links.

A record is read once, in an Arrow batch, and every array level of it is exploded with
explicit stacks: each object carries the surrogate key of its parent and its ordinal among
its siblings from the start, so that neither the plan nor the rows of other records depend
on how deep one record is, and nothing is exchanged. ``node_table`` explodes a recursive
array (``structure`` and its ``children``), ``child_table`` an array at a given path,
``flat_records`` all objects of all arrays; ``infer_paths`` merges the schemas of all
records, which gives ``flat_table`` its columns.

Defined cases: a null or blank payload gives no rows; text around the JSON object is
ignored; a payload that holds no whole object gives no rows and is listed by
``broken_records``; a list, a list of lists, a single object, and the JSON text of any of
them hold objects; values that are no objects give no rows; of a key met twice in one
object the last counts; numbers stay as written; there is no limit on depth or size but the
2 GB of one value; other columns of the input are ignored, so clashing names do no harm;
keys must be unique.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one batch that a worker sends on.
BATCH = 20_000


class Number(str):
    """A JSON number as written."""


def _constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("[^"\\\x00-\x1f]*(?:\\.[^"\\\x00-\x1f]*)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(true|false|null))', re.A | re.S)
_WORDS = {"true": True, "false": False, "null": None}


def _read(text: str) -> object:
    """What ``json.loads`` gives, with a stack of its own in place of recursion."""
    at, held, keys, got, want = 0, [], [], None, "value"
    while True:
        m = _TOKEN.match(text, at)
        if m is None:
            raise ValueError(f"no JSON at {at}")
        at = m.end()
        sign, quoted, number, word = m.groups()
        if sign in ("{", "[") and want in ("value", "value or ]"):
            held.append({} if sign == "{" else [])
            keys.append(None)
            want = "key or }" if sign == "{" else "value or ]"
            continue
        if quoted is not None and want in ("key", "key or }"):
            keys[-1] = json.loads(quoted)
            want = ":"
            continue
        if sign == ":" and want == ":":
            want = "value"
            continue
        if sign == "," and want == "end":
            want = "key" if isinstance(held[-1], dict) else "value"
            continue
        if sign == "}" and held and isinstance(held[-1], dict) and want in ("end", "key or }") or sign == "]" and held and isinstance(held[-1], list) and want in ("end", "value or ]"):
            got = held.pop()
            keys.pop()
        elif sign is None and want in ("value", "value or ]"):
            got = json.loads(quoted) if quoted is not None else Number(number) if number is not None else _WORDS[word]
        else:
            raise ValueError(f"unexpected at {at}")
        if not held:
            if text[at:].strip(" \t\n\r"):
                raise ValueError(f"more after the end at {at}")
            return got
        if isinstance(held[-1], dict):
            held[-1][keys[-1]] = got
        else:
            held[-1].append(got)
        want = "end"


def loads(text: str) -> object:
    """The value of a JSON text of any depth, numbers as written; ValueError if it is none."""
    try:
        return json.loads(text, parse_int=Number, parse_float=Number, parse_constant=_constant)
    except RecursionError:
        return _read(text)


def record(text: str | None) -> dict:
    """The JSON object from the first ``{`` to the last ``}`` of ``text``; ValueError if that is none."""
    text = text or ""
    start, end = text.find("{"), text.rfind("}")
    if start < 0 or end < start:
        raise ValueError("no object")
    return loads(text[start : end + 1])


def opened(x: object) -> object:
    """``x``, or what it holds if it is the JSON text of a list or an object."""
    if isinstance(x, str) and not isinstance(x, Number) and x.lstrip()[:1] in ("{", "["):
        try:
            return loads(x)
        except ValueError:
            pass
    return x


def objects(x: object) -> list[dict]:
    """The objects held by ``x`` in order, whatever form they are held in."""
    out, todo = [], [x]
    while todo:
        x = opened(todo.pop())
        if isinstance(x, dict):
            out.append(x)
        elif isinstance(x, list):
            todo.extend(reversed(x))
    return out


def written(x: object) -> str | None:
    """A value as STRING: text and numbers as written, lists and objects as compact JSON."""
    if x is None or isinstance(x, str):
        return None if x is None else str(x)
    out, todo = [], [x]
    raw = object()  # marks what is to be put out as it is
    while todo:
        x = todo.pop()
        if isinstance(x, tuple) and x[0] is raw:
            out.append(x[1])
        elif isinstance(x, dict):
            parts = [[(raw, f"{json.dumps(k, ensure_ascii=False)}:"), v] for k, v in x.items()]
            todo.append((raw, "}"))
            for n, part in enumerate(reversed(parts)):
                todo += [part[1], part[0]] + ([(raw, ",")] if n < len(parts) - 1 else [])
            todo.append((raw, "{"))
        elif isinstance(x, list):
            todo.append((raw, "]"))
            for n, v in enumerate(reversed(x)):
                todo += [v] + ([(raw, ",")] if n < len(x) - 1 else [])
            todo.append((raw, "["))
        else:
            out.append("null" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, Number) else json.dumps(x, ensure_ascii=False))
    return "".join(out)


def nodes(top: dict, root: str, child: str) -> Iterator[tuple[int, int, int, int, dict]]:
    """(pos, parent, depth, ord, object) of every object under ``root``, a node before its children."""
    todo = [(o, -1, 0, i) for i, o in enumerate(objects(top.get(root)))][::-1]
    pos = 0
    while todo:
        o, parent, depth, i = todo.pop()
        yield pos, parent, depth, i, o
        if o.get(child) is not None:
            todo.extend([(c, pos, depth + 1, j) for j, c in enumerate(objects(o[child]))][::-1])
        pos += 1


def _rows(make: Callable[[str | None], Iterator[tuple]], names: list[str], kinds: list[pa.DataType]):
    """A mapInArrow function: the key of each row beside the tuples that ``make`` gives for its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1)):
                for row in make(text.as_py()):
                    at.append(i)
                    rows.append(row)
                    if len(rows) == BATCH:
                        yield pack(batch, at, rows)
                        at, rows = [], []
            yield pack(batch, at, rows)

    def pack(batch: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.record_batch([batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(c, kind) for c, kind in zip(columns, kinds))], ["k", *names])

    return run


def _map(df: DataFrame, key: str, json_col: str, make: Callable[[str | None], Iterator[tuple]], columns: dict[str, str]) -> DataFrame:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    rows = df.select(F.col(key).alias("k"), F.col(json_col).alias("j"))
    schema = ", ".join([f"k {rows.schema['k'].dataType.simpleString()}", *(f"`{n}` {kind}" for n, kind in columns.items())])
    return rows.mapInArrow(_rows(make, list(columns), [kinds[k] for k in columns.values()]), schema).withColumnRenamed("k", key)


def _parsed(text: str | None) -> dict | None:
    try:
        return record(text)
    except ValueError:
        return None


def json_object(text: Column) -> Column:
    """The VARIANT of the JSON object in ``text``, for values of up to Spark's limit of a VARIANT; NULL if that does not parse."""
    start = F.locate("{", text)
    end = F.length(text) - F.locate("}", F.reverse(text)) + 1
    return F.when((start > 0) & (end > start), F.try_parse_json(F.substring(text, start, end - start + 1)))


def node_table(df: DataFrame, key: str = "record_id", json_col: str = "payload", root: str = "structure", child: str = "children", fields: tuple[str, ...] = ("type", "number", "title", "text")) -> DataFrame:
    """One row per object under ``root`` or the ``child`` of such an object.

    Columns: ``key``, ``pos`` (from 0, a node before its children), ``parent_pos`` (-1
    at the top), ``depth``, ``ord`` (place among its siblings) and ``fields`` as STRING
    as written (NULL when missing).
    """

    def make(text: str | None) -> Iterator[tuple]:
        top = _parsed(text)
        if top is not None:
            for *place, o in nodes(top, root, child):
                yield *place, *(written(o.get(f)) for f in fields)

    return _map(df, key, json_col, make, {"pos": "int", "parent_pos": "int", "depth": "int", "ord": "int"} | {f"node_{f}": "string" for f in fields})


def child_table(df: DataFrame, path: tuple[str, ...], key: str = "record_id", json_col: str = "payload", fields: tuple[str, ...] = ()) -> DataFrame:
    """The objects of the arrays at ``path`` (say ``("metadata", "references")``), array within array.

    Columns: ``key``, ``ord0`` .. one ordinal for each array on the way (the last is the
    row's own, the others are its parent's key), then ``fields`` as STRING.
    """

    def make(text: str | None) -> Iterator[tuple]:
        todo = [((), _parsed(text) or {})]
        while todo:
            place, o = todo.pop()
            if len(place) == len(path):
                yield *place, *(written(o.get(f)) for f in fields)
            else:
                todo.extend([((*place, i), x) for i, x in enumerate(objects(o.get(path[len(place)])))][::-1])

    return _map(df, key, json_col, make, {f"ord{i}": "int" for i in range(len(path))} | {f: "string" for f in fields})


def broken_records(df: DataFrame, key: str = "record_id", json_col: str = "payload") -> DataFrame:
    """(``key``, reason) of every payload that is not blank and holds no whole JSON object."""

    def make(text: str | None) -> Iterator[tuple]:
        if text and text.strip():
            try:
                record(text)
            except ValueError as e:
                yield (str(e),)

    return _map(df, key, json_col, make, {"reason": "string"})


def _kind(x: object) -> str:
    if isinstance(x, Number):
        return "integer" if x.lstrip("-").isdigit() else "number"
    return {dict: "object", list: "array", str: "string", bool: "boolean"}.get(type(x), "null")


def _step(path: str, step: str) -> str:
    """``path`` with ``step``; a step that repeats itself, as in a recursive array, is given once, with ``*``."""
    return path if path.endswith(f"{step}*") else f"{path}*" if path.endswith(step) else path + step


def _flat(top: dict, arrays: set[str]) -> Iterator[tuple[str, int, int, int, dict]]:
    """(path, id, parent, ord, object) of the record and of every object of an array in it, in document order; single objects are part of their holder."""
    todo, n = [("$", -1, 0, top)], 0
    while todo:
        path, parent, i, o = todo.pop()
        plain, found, inner = {}, [], [("", o)]
        while inner:
            prefix, x = inner.pop()
            for name, v in x.items():
                v = opened(v)
                held = objects(v) if isinstance(v, list) or isinstance(v, dict) and name in arrays else []
                if held:
                    found.append((f".{prefix}{name}[]", held))
                elif isinstance(v, dict):
                    inner.append((f"{prefix}{name}.", v))
                else:
                    plain[f"{prefix}{name}"] = v
        yield path, n, parent, i, plain
        todo.extend([(_step(path, step), n, j, x) for step, held in found for j, x in enumerate(held)][::-1])
        n += 1


def flat_records(df: DataFrame, key: str = "record_id", json_col: str = "payload", arrays: set[str] | None = None) -> DataFrame:
    """Every array of objects as rows of one table: (``key``, path, id, parent_id, ord, fields).

    ``id`` counts the rows of a record from 0, the record itself, whose ``parent_id`` is -1.
    ``fields`` maps the names of plain values to STRING; those of single objects have their
    holder's name before them. ``arrays`` are the keys whose single objects count as lists of
    one; where none are given they are those that hold a list anywhere, by ``infer_paths``
    (a list of names, as long as the schema and not as the data).
    """
    if arrays is None:
        arrays = {r.name for r in infer_paths(df, json_col).where("kind = 'array'").select(F.regexp_extract("path", r"([^.\[\]]+)[\[\]*]*$", 1).alias("name")).distinct().collect()}

    def make(text: str | None) -> Iterator[tuple]:
        top = _parsed(text)
        if top is not None:
            for path, n, parent, i, o in _flat(top, arrays):
                yield path, n, parent, i, [(k, written(v)) for k, v in o.items()]

    return _map(df, key, json_col, make, {"path": "string", "id": "int", "parent_id": "int", "ord": "int", "fields": "map<string,string>"})


def flat_table(flat: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """The rows of ``flat_records`` at ``path`` with ``columns`` of their fields, say those that ``infer_paths`` gives below it."""
    return flat.where(F.col("path") == path).select(*[c for c in flat.columns if c not in ("path", "fields")], *[F.col("fields")[c].alias(c) for c in columns])


def _walk(x: object, seen: Counter) -> None:
    todo = [("$", "$", x)]
    while todo:
        path, inside, x = todo.pop()
        x = opened(x)
        seen[path, _kind(x)] += 1
        if isinstance(x, dict):
            todo += [(f"{path}.{k}", _step(path, f".{k}[]"), v) for k, v in x.items()]
        elif isinstance(x, list):
            todo += [(inside, inside if inside.endswith("[][]") else f"{inside}[]", v) for v in x]


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            top = _parsed(text.as_py())
            if top is not None:
                _walk(top, seen)
        if len(seen) > 100_000:
            yield _path_batch(seen)
            seen.clear()
    yield _path_batch(seen)


def _path_batch(seen: Counter) -> pa.RecordBatch:
    return pa.record_batch([pa.array([p for p, _ in seen], pa.string()), pa.array([k for _, k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["path", "kind", "n"])


def infer_paths(df: DataFrame, json_col: str = "payload") -> DataFrame:
    """The merged schema of all records: (path, kind, n), one row per path and kind of value.

    Arrays add ``[]`` to a path; lists and objects held as JSON text are opened; a step that
    repeats itself is given once, so that a recursive array has one path at all depths. Each
    task sends one row per distinct path, so the exchange does not grow with the rows.
    """
    return df.select(F.col(json_col)).mapInArrow(_paths, "path string, kind string, n long").groupBy("path", "kind").agg(F.sum("n").alias("n"))
