"""Markers in text: ``<TEXT, id:ID>`` and ``[[ENT id=.. type=.. norm=".."]]TEXT[[/ENT]]``."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<id:string,type:string,text:string,start_char:int,end_char:int,normalized:string>"
#: Arrays of spans have this type; offsets count code points.
SPANS = f"array<{SPAN}>"


def strip_markers(text: Column, replacement: str = "$1") -> Column:
    """``text`` with each ``<TEXT, id:ID>`` as TEXT."""
    return F.regexp_replace(text, r"<([^,<>]+), id:[^>]+>", replacement)


def write_markers(text: Column, spans: Column) -> Column:
    """Explicit markers around the spans, from left to right; overlapping and invalid spans are left out.

    One fold over the sorted spans inside the JVM.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start_char"].alias("a"), s["end_char"].alias("b"), s["id"].alias("id"), s["type"].alias("type"), s["normalized"].alias("norm"))))
    norm = lambda s: F.when(F.coalesce(s["norm"], F.lit("")) != "", F.concat(F.lit(' norm="'), F.replace(s["norm"], F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise("")
    piece = lambda a, b: F.substring(text, a + 1, b - a)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        fits = F.coalesce((s["a"] >= acc["at"]) & (s["b"] > s["a"]) & (s["b"] <= F.length(text)), F.lit(False))
        mark = F.concat(piece(acc["at"], s["a"]), F.lit("[[ENT id="), s["id"], F.lit(" type="), s["type"], norm(s), F.lit("]]"), piece(s["a"], s["b"]), F.lit("[[/ENT]]"))
        return F.struct(F.when(fits, F.concat(acc["out"], mark)).otherwise(acc["out"]).alias("out"), F.when(fits, s["b"]).otherwise(acc["at"]).alias("at"))

    return F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], piece(acc["at"], F.length(text))))


_TAG = re.compile(r"\[\[ENT ([^\]]*)\]\](.*?)\[\[/ENT\]\]", re.S)
_ATTRIBUTE = re.compile(r"""(\w+)=(?:"((?:\\"|[^"])*)"|'([^']*)'|(\S+))""")


def read_marked(marked: str | None) -> dict | None:
    """The plain text and the spans of text with explicit markers; offsets are those in the plain text.

    A tag that is not closed stays as it is. NULL gives NULL.
    """
    if marked is None:
        return None
    out, spans, at, size = [], [], 0, 0
    for m in _TAG.finditer(marked):
        plain = marked[at : m.start()]
        size += len(plain)
        given = {k: next(v for v in values if v or v is values[-1]) for k, *values in _ATTRIBUTE.findall(m[1])}
        norm = given.get("norm")
        spans.append({"id": given.get("id"), "type": given.get("type"), "text": m[2], "start_char": size, "end_char": size + len(m[2]), "normalized": norm.replace('\\"', '"') if norm else None})
        out += [plain, m[2]]
        size += len(m[2])
        at = m.end()
    out.append(marked[at:])
    return {"text": "".join(out), "spans": spans}


def insert_brackets(text: str | None, entities: list[dict] | None) -> str | None:
    """``<TEXT, id:ID>`` around every occurrence of each entity's text, longest text first, never inside a marker."""
    if text is None:
        return None
    seen, pairs = set(), []
    for e in entities or ():
        pair = (e["text"], e["id"])
        if e["text"] and pair not in seen:
            seen.add(pair)
            pairs.append(pair)
    for word, id_ in sorted(pairs, key=lambda p: -len(p[0])):
        parts = re.split(r"(<[^>]*>)", text)
        parts[::2] = [p.replace(word, f"<{word}, id:{id_}>") for p in parts[::2]]
        text = "".join(parts)
    return text


def highlight(text: str | None, entities: list[dict] | None) -> str | None:
    """HTML with ``<mark>`` around the entities' texts, the longest first at each place."""
    if text is None:
        return None
    found = sorted({e["text"] for e in entities or () if e["text"]}, key=lambda t: (-len(t), t))
    if not found:
        return html.escape(text)
    pattern = re.compile("|".join(map(re.escape, found)))
    out, at = [], 0
    for m in pattern.finditer(text):
        out += [html.escape(text[at : m.start()]), f"<mark>{html.escape(m[0])}</mark>"]
        at = m.end()
    return "".join(out) + html.escape(text[at:])


def render_spans(text: str | None, spans: list[dict] | None, near: int = 50) -> str | None:
    """HTML with a titled ``<span>`` for each span. A span whose text is not at its offsets is looked for
    within ``near`` characters, the nearest first, and left out if it is not there or overlaps."""
    if text is None:
        return None
    out, at = [], 0
    for s in sorted(spans or (), key=lambda s: (s["start_char"], s["end_char"])):
        a, b, word = s["start_char"], s["end_char"], s["text"]
        if word and text[max(a, 0) : b] != word:
            places = [m.start() for m in re.finditer(re.escape(word), text[max(a - near, 0) : a + near + len(word)])]
            if not places:
                continue
            a = min((p + max(a - near, 0) for p in places), key=lambda p: abs(p - s["start_char"]))
            b = a + len(word)
        if a < at or b <= a or b > len(text):
            continue
        tip = f"{s['type']}: {s['normalized']}" if s.get("normalized") else s["type"]
        out += [html.escape(text[at:a]), f'<span class="entity" id="entity-{html.escape(str(s["id"]))}" title="{html.escape(tip)}">', html.escape(text[a:b]), "</span>"]
        at = b
    return "".join(out) + html.escape(text[at:])


def parse_marked_text(marked: Column) -> Column:
    """``read_marked`` over Arrow batches: STRUCT(text, spans)."""

    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_marked(m) or {"text": None, "spans": None} for m in values], columns=["text", "spans"])

    return F.pandas_udf(run, f"struct<text:string,spans:{SPANS}>", F.PandasUDFType.SCALAR)(marked)


def _over_spans(function, text: Column, spans: Column) -> Column:
    def run(texts: pd.Series, held: pd.Series) -> pd.Series:
        return pd.Series([function(t, [dict(s) for s in e] if e is not None else []) for t, e in zip(texts, held)], dtype=object)

    return F.pandas_udf(run, "string", F.PandasUDFType.SCALAR)(text, spans)


def mark_entities(text: Column, spans: Column) -> Column:
    return _over_spans(insert_brackets, text, spans)


def highlight_entities(text: Column, spans: Column) -> Column:
    return _over_spans(highlight, text, spans)


def render_html(text: Column, spans: Column) -> Column:
    return _over_spans(render_spans, text, spans)
