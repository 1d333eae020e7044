"""The best representative of each group of versions, by token-level consensus.

Versions of a group are collapsed to distinct values with counts; every other value is
aligned by itself to a leading one, which gives the columns of the group, and only where
they differ it casts votes, summed by column over the whole group. The existing value
nearest the tokens of greatest weight represents the group. No task holds a group, and its
size does not change the result. Weights say what "best" means.

``votes`` weighs a value by its number of copies; the leading value is the one with most.

``trust`` gives each text more weight than all those after it together (most trusted
source, latest, smallest key). Every column then takes the token of the first usable text,
so that this one is nearest the consensus and no sums are needed; what the alignment
decides is whether it is whole. A text that runs through the columns of another usable one
and breaks off where that goes on within the sentence is cut off, whatever its last sign,
and the next one leads.

Defined cases: rows without a group value are left out; a usable text is one with letters
that is no filler and ends a sentence; where no text of a group is usable all take part;
ties go to the earlier row in the order above; a null source or time comes last; equal
rows are copies of one value; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raqim.operators.lineage import cut

#: What stands for a missing text.
FILLERS = ("n/a", "...", "…", "-", "—", "null", "none", "néant", "à compléter", "texte manquant", "[illisible]", "بدون نص", "(بدون نص)", "يراجع الأصل", "غير مقروء", "؟؟؟")
GROUP_CHARS = 32_000_000


def article_number(number: Column) -> Column:
    """The digits of a number as 0-9, with `` bis`` after a number with that suffix; NULL without digits."""
    plain = F.translate(number, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹０１２３４５６７８９", "0123456789" * 3)
    digits = F.nullif(F.regexp_extract(plain, r"\d+", 0), F.lit(""))
    return F.concat(digits, F.when(F.lower(plain).rlike(r"مكرر|\bbis\b"), " bis").otherwise(""))


def usable(text: Column) -> Column:
    """Not missing, blank or a filler, and not cut off before the end of its last sentence."""
    bare = F.trim(F.regexp_replace(text, r"^[\s ]+|[\s ]+$", ""))
    whole = bare.rlike(r"[.!?؟۔][»”\"')\]]*$") & ~bare.rlike(r"(?:\.\.|…)[»”\"')\]]*$")
    return F.coalesce(whole & bare.rlike(r"\p{L}") & ~F.lower(bare).isin(*FILLERS), F.lit(False))


def _anchors(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of tokens met once in each of both, as many as run forward in both."""
    once = lambda x: {t: i for i, t in enumerate(x) if n[t] == 1} if (n := Counter(x)) else {}
    left, right = once(a), once(b)
    pairs = [(i, right[t]) for t, i in left.items() if t in right]
    # longest increasing run of the second places
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        tops[at : at + 1], ends[at : at + 1] = [j], [k]
        back.append(ends[at - 1] if at else -1)
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def differing(a: list[str], b: list[str]) -> list[tuple[int, int, int, int]]:
    """(i, j, k, l): ``a[i:j]`` stands where ``b`` has ``b[k:l]``; what lies between is equal.

    Equal ends are set aside and tokens met once anchor the rest, so that the quadratic
    comparison meets only the stretches between.
    """
    out: list[tuple[int, int, int, int]] = []
    todo = [(0, len(a), 0, len(b), True)]
    while todo:
        i, j, k, l, anchored = todo.pop()
        while i < j and k < l and a[i] == b[k]:
            i, k = i + 1, k + 1
        while i < j and k < l and a[j - 1] == b[l - 1]:
            j, l = j - 1, l - 1
        if i == j or k == l:
            out += [(i, j, k, l)] if i < j or k < l else []
        elif anchored and (j - i) * (l - k) > 10_000 and (places := _anchors(a[i:j], b[k:l])):
            edges = [(i, k), *((i + x, k + y) for x, y in places), (j, l)]
            todo += [(p, r, q, s, len(places) > 1) for (p, q), (r, s) in zip(edges, edges[1:])]
        else:
            out += [(i + p, i + q, k + r, k + s) for tag, p, q, r, s in SequenceMatcher(None, a[i:j], b[k:l], autojunk=False).get_opcodes() if tag != "equal"]
    return sorted(out)


def distance(tokens: list[str], agreed: list[str]) -> float:
    """Share of the tokens of both that have no equal in the other."""
    apart = sum(j - i + l - k for i, j, k, l in differing(tokens, agreed))
    return apart / max(len(tokens) + len(agreed), 1)


def differences(base: list[str], tokens: list[str]) -> list[tuple[int, int, str]]:
    """(at, further, token) where ``tokens`` differ from ``base``: the place of the base, or one of those inserted after it."""
    out = []
    for a, b, c, d in differing(base, tokens):
        for k in range(max(b - a, d - c)):
            at, further = (a + k, 0) if a + k < b else (b - 1, 1 + k - (b - a))
            out.append((at, further, tokens[c + k] if c + k < d else ""))
    return out


def goes_on(base: list[str], tokens: list[str]) -> bool:
    """True if ``tokens`` run through all columns of ``base`` and carry on its last sentence: with a small letter or a digit."""
    parts = differing(base, tokens)
    if len(parts) != 1 or not base:
        return False
    a, b, c, d = parts[0]
    if b != len(base) or d != len(tokens) or d - c <= b - a or b - a > 1:
        return False
    if b - a == 1:  # the last word itself is broken off
        return len(tokens[c]) > len(base[a].rstrip(".")) > 0 and tokens[c].startswith(base[a].rstrip("."))
    return tokens[c][0].islower() or tokens[c][0].isdigit()


def edited(base: list[str], edits: list[tuple[int, int, str]]) -> list[str]:
    """``base`` with the tokens of ``edits`` in their places."""
    places = {(i, 0): t for i, t in enumerate(base)} | {(i, j): t for i, j, t in edits}
    return [places[k] for k in sorted(places) if places[k]]


def _differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_columns - 3
        rows = [(r, copies, *e) for r, (base, text, copies) in enumerate(zip(*(batch.column(n + i).to_pylist() for i in range(3)))) for e in differences((base or "").split(), (text or "").split())]
        votes = [pa.array([x[i] for x in rows], kind) for i, kind in ((2, pa.int32()), (3, pa.int32()), (4, pa.string()), (1, pa.int64()))]
        at = pa.array([x[0] for x in rows], pa.int32())
        yield pa.record_batch([*(batch.column(i).take(at) for i in range(n)), *votes], [*batch.schema.names[:n], "at", "further", "token", "copies"])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bases, texts, edits = (batch.column(batch.num_columns - 3 + i).to_pylist() for i in range(3))
        far = [distance((t or "").split(), edited((b or "").split(), [(e["at"], e["further"], e["token"]) for e in x or ()])) for b, t, x in zip(bases, texts, edits)]
        kept = range(batch.num_columns - 3)
        yield pa.record_batch([*(batch.column(i) for i in kept), batch.column(batch.num_columns - 2), pa.array(far, pa.float64())], [*(batch.schema.names[i] for i in kept), "text", "far"])


def _schema(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def _voted(texts: DataFrame, names: list[str]) -> DataFrame:
    """(names, row) of the text of each group nearest what most copies agree on."""
    texts = cut(texts.select(*names, "text", F.col("first.late").alias("late"), F.col("first.id").alias("id"), "copies", F.col("first.late")[0].alias("use")))
    order = F.struct("use", (-F.col("copies")).alias("fewer"), "late", "id")
    held = texts.groupBy(*names).agg(F.min("use").alias("_use"), F.min_by("text", order).alias("base"), F.sum(F.when(F.col("use") == 0, F.col("copies"))).alias("good"), F.sum("copies").alias("versions"))
    held = cut(held.withColumn("total", F.coalesce("good", "versions")))
    voting = cut(texts.join(held.select(*names, "_use", "base"), names).where(F.col("use") == F.col("_use")))  # the usable ones, or all
    other = voting.where(~F.col("text").eqNullSafe(F.col("base"))).select(*names, "base", "text", "copies")
    votes = other.mapInArrow(_differ, f"{_schema(other, names)}, at int, further int, token string, copies bigint")
    counted = votes.groupBy(*names, "at", "further", "token").agg(F.sum("copies").alias("n")).groupBy(*names, "at", "further").agg(F.sum("n").alias("all"), F.max(F.struct("n", "token")).alias("top"))
    # what does not differ there votes for the base
    won = counted.join(held.select(*names, "total"), names).where(F.col("top.n") > F.col("total") - F.col("all"))
    edits = won.groupBy(*names).agg(F.collect_list(F.struct("at", "further", F.col("top.token").alias("token"))).alias("edits"))
    asked = voting.join(cut(edits), names, "left").select(*names, "late", "id", "copies", "base", "text", "edits")
    far = asked.mapInArrow(_measure, f"{_schema(asked, [*names, 'late', 'id', 'copies'])}, text string, far double")
    best = far.groupBy(*names).agg(F.min_by(F.struct("id", "text"), F.struct("far", (-F.col("copies")).alias("fewer"), "late", "id")).alias("best"))
    return best.join(held.select(*names, "versions"), names).select(*names, F.struct(F.col("best.id").alias("id"), F.col("best.text").alias("text"), F.col("versions").alias("copies")).alias("row"))


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_columns - 2
        more = [goes_on(b.split(), t.split()) for b, t in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist())]
        yield batch.select(range(n)).filter(pa.array(more, pa.bool_()))


def _trusted(texts: DataFrame, names: list[str]) -> DataFrame:
    """(names, row) of the first usable text of each group that no other one shows to be cut off."""
    texts = texts.select(*names, "text", F.col("first.late").alias("late"), F.col("first.id").alias("id"), "copies", F.col("first.late")[0].alias("use"))
    texts = cut(texts)
    done, dropped = [], None
    while True:
        left = texts if dropped is None else texts.join(dropped.select(*names).distinct(), names, "left_semi").join(dropped.select(*names, "id", F.lit(1).alias("off")), [*names, "id"], "left")
        left = left if dropped is not None else left.withColumn("off", F.lit(None).cast("int"))
        order = F.struct(F.when(F.col("off").isNull(), F.col("use")).otherwise(1).alias("use"), "late", "id")
        led = left.groupBy(*names).agg(F.min_by(F.struct("id", "text", "use", "off"), order).alias("best"), F.sum("copies").alias("versions"), F.count_if((F.col("use") == 0) & F.col("off").isNull()).alias("usable"))
        led = cut(led)
        # a leading text is compared with each other usable one, and with those found cut off before by none
        asked = left.where("use = 0 AND off IS NULL").join(led.where("usable > 1").select(*names, F.col("best.id").alias("_id"), F.col("best.text").alias("base")), names).where("id <> _id").select(*names, F.col("_id").alias("id"), "base", "text")
        kinds = ", ".join(f"`{n}` {asked.schema[n].dataType.simpleString()}" for n in [*names, "id"])
        found = cut(asked.mapInArrow(_carried, kinds).distinct())
        row = F.struct(F.col("best.id").alias("id"), F.col("best.text").alias("text"), F.col("versions").alias("copies")).alias("row")
        if found.isEmpty():
            done.append(led.select(*names, row))
            break
        done.append(led.join(found.select(*names), names, "left_anti").select(*names, row))
        dropped = found if dropped is None else cut(dropped.join(found.select(*names), names, "left_semi").unionByName(found))
    return reduce(DataFrame.unionByName, done)


def best_version(df: DataFrame, group: dict[str, Column], key: str = "article_id", text: str = "text", order: tuple[Column, ...] = (), policy: str = "trust", fit: Callable[[Column], Column] = usable) -> DataFrame:
    """(group columns, ``key``, ``text``, versions) of each group with two rows or more.

    ``order`` are BIGINT columns that decide between usable rows, smallest first; ``fit``
    says what values are usable, by default for texts.
    """
    names = list(group)
    late = F.array(F.when(fit(F.col(text)), 0).otherwise(1).cast("bigint"), *[F.coalesce(c.cast("bigint"), F.lit(2**62)) for c in order])
    rows = df.select(*[c.alias(n) for n, c in group.items()], late.alias("late"), F.col(key).alias("id"), F.col(text).alias("t"))
    rows = rows.where(F.concat(*[F.col(n).cast("string") for n in names]).isNotNull())
    several = cut(rows.groupBy(*names).agg(F.count("*").alias("versions")).where("versions > 1"))
    size = several.agg(F.sum(sum((F.length(F.col(n).cast("string")) for n in names), F.lit(8)))).first()
    # only rows of groups with several move; the groups are broadcast if proven small
    rows = rows.join(F.broadcast(several) if (size[0] or 0) <= GROUP_CHARS else several, names)
    texts = rows.groupBy(*names, F.col("t").alias("text")).agg(F.min(F.struct("late", "id")).alias("first"), F.count("*").alias("copies"))
    chosen = _voted(texts, names) if policy == "votes" else _trusted(texts, names)
    return chosen.select(*names, F.col("row.id").alias(key), F.col("row.text").alias(text), F.col("row.copies").alias("versions"))
