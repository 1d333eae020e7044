"""Extraction of structure from texts by a language model, outline first and then chunk by chunk.

The model is any function from a prompt to a reply, called in the workers; tests give
recorded ones. Chunks of one document are asked for in order, since each prompt carries what
the reply before said it stands in and the end of the chunk before; documents are
independent of each other. Null and empty texts are not asked for.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raqim.operators.nested import loads, written

Model = Callable[[str], str]

#: Fixed value: the line of a reply that names what its nodes stand in.
_INHERITED = re.compile(r'^Inherited context:\s*type=([^,]+),\s*number=([^,]+),\s*title="([^"]*)"')
#: Fixed value: what asks a model to mend a reply.
REPAIR = 'Return a JSON object {"result": [...]}. If the array can\'t be recovered, use an empty array.\n'
_FENCE = re.compile(r"^```(?:json)?\s*|\s*```$", re.I)


def completion_budget(used: Column, limits: Column) -> Column:
    """Tokens that a reply may take: what the prompt leaves of the context, at most the model's own limit; NULL where nothing is left."""
    left = limits["context"] - used
    return F.when(left > 0, F.least(left, limits["completion"]))


def inherited(reply: str) -> tuple[str, tuple[str, str, str] | None, str]:
    """(line, (type, number, title), rest) of a reply; '' and None without an inherited-context line."""
    text = reply.lstrip()
    if not text.startswith("Inherited context:"):
        return "", None, reply
    line, _, rest = text.partition("\n")
    m = _INHERITED.match(line)
    return line, m and (m[1].strip(), m[2].strip(), m[3].strip()), rest.lstrip()


def nodes_of_reply(reply: str | None) -> list | None:
    """The nodes of a reply, a list or one object, with or without a code fence; None if it is not JSON."""
    text = _FENCE.sub("", (reply or "").strip())
    for tried in (text, re.sub(r"\\u(?![0-9a-fA-F]{4})", r"\\\\u", text)):
        try:
            got = loads(tried)
        except ValueError:
            continue
        return got if isinstance(got, list) else [got] if isinstance(got, dict) else []
    return None


def repaired(reply: str, model: Model) -> list:
    """The nodes that the model makes of a reply that is not JSON; none if it can't."""
    got = nodes_of_reply(model(REPAIR + reply))
    held = got[0].get("result") if got and len(got) == 1 and isinstance(got[0], dict) and "result" in got[0] else got
    return held if isinstance(held, list) else []


def extract_in_order(chunks: list[str], model: Model, prompt: Callable[[str], str], tail: int) -> Iterator[tuple[int, tuple | None, object]]:
    """(chunk, what it stands in, node) of all nodes of the chunks of one document.

    A chunk whose reply gives no nodes is asked for again in halves.
    """
    line, before = "", ""
    for i, chunk in enumerate(chunks):
        carried = f"{line}\n" if line else ""
        reply = model(prompt(carried + before + chunk))
        line, within, rest = inherited(reply)
        nodes = nodes_of_reply(rest)
        if nodes is None:
            nodes = repaired(reply, model)
        for half in (chunk[: len(chunk) // 2], chunk[len(chunk) // 2 :]) if not nodes else ():
            again = inherited(model(prompt((f"{line}\n" if line else "") + half)))
            nodes = [*nodes, *(nodes_of_reply(again[2]) or [])]
        yield from ((i, within, n) for n in nodes)
        before = chunk[-tail:] if tail else ""


def extract_nodes(chunks: DataFrame, model: Model, instructions: str, end: str, key: str = "doc_id", tail: int = 400) -> DataFrame:
    """(``key``, chunk, idx, in_type, in_number, in_title, node): every node of every chunk, as JSON, in the order given.

    chunks (``key``, chunk, chunk_text). ``tail`` code points of the chunk before go with each prompt.
    """
    held = chunks.where("chunk_text <> ''").groupBy(F.col(key).alias("k")).agg(F.array_sort(F.collect_list(F.struct("chunk", "chunk_text"))).alias("held"))
    kind = held.schema["k"].dataType.simpleString()
    names = ("chunk", "idx", "in_type", "in_number", "in_title", "node")
    types = (pa.int32(), pa.int32(), *[pa.string()] * 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, parts in enumerate(b.column(1)):
                parts = parts.as_py()
                found = extract_in_order([p["chunk_text"] for p in parts], model, lambda body: f"{instructions}\n{body}\n{end}", tail)
                rows = [(parts[c]["chunk"], n, *(within or (None,) * 3), written(node)) for n, (c, within, node) in enumerate(found)]
                columns = list(zip(*rows)) or [()] * len(names)
                yield pa.record_batch([b.column(0).take(pa.array([i] * len(rows), pa.int32())), *(pa.array(c, t) for c, t in zip(columns, types))], ["k", *names])

    return held.mapInArrow(run, f"k {kind}, chunk int, idx int, in_type string, in_number string, in_title string, node string").withColumnRenamed("k", key)


def extract_outlines(df: DataFrame, model: Model, instructions: str, end: str, budget: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, payload, ok): the outline of each document from its first ``budget`` code points, as JSON.

    A reply that is not JSON is mended by the model; ``ok`` is false where that gives nothing.
    """
    rows = df.where(F.length(text) > 0).select(F.col(key).alias("k"), F.substring(F.col(text), 1, budget).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()

    def one(body: str) -> tuple[str, bool]:
        reply = model(f"{instructions}\n{body}\n{end}")
        nodes = nodes_of_reply(reply)
        if nodes is not None and len(nodes) == 1 and isinstance(nodes[0], dict):
            return written(nodes[0]), True
        nodes = repaired(reply, model) if nodes is None else nodes
        return written({"structure": nodes}), bool(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [one(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.bool_())], ["k", "payload", "ok"])

    return rows.mapInArrow(run, f"k {kind}, payload string, ok boolean").withColumnRenamed("k", key)


def summaries(df: DataFrame, model: Model, instructions: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, payload, ok): what the model makes of whole texts, as one JSON object, mended like an outline."""
    longest = 2**31 - 1
    return extract_outlines(df, model, instructions, "", longest, key, text)
