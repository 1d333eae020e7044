"""Operators on flat node tables: (doc, pos, parent_pos, type, number, text).

``pos`` is the place in document order, a node before its children; ``parent_pos`` is
NULL (or negative) at the top. Every operator partitions by document once; ancestors are
window functions over ``pos``, one per level, since the last node of each smaller depth is
an ancestor. No operator recurses or loops over rows. Trees may be of any depth: ``levels``
only says how many are climbed in one plan; where parents are left after that, each further
round doubles the levels climbed. A node that is its own ancestor is an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raqim.functions.numbers import clean_number, drop_stray_digit
from raqim.functions.text import canonical_type
from raqim.functions.vocabulary import RANK
from raqim.operators.lineage import cut

#: Levels climbed in one plan; the ranks allow six levels, raw replies a few more.
LEVELS = 8
#: Numbers generated at a time where a gap is filled.
CHUNK = 4096


def _order(doc: str = "doc"):
    return Window.partitionBy(doc).orderBy("pos")


def _before(doc: str = "doc"):
    return _order(doc).rowsBetween(Window.unboundedPreceding, -1)


def build_hierarchy(df: DataFrame, rank: Column, ranks: int = len(RANK)) -> DataFrame:
    """``parent_pos``: the nearest earlier node of smaller rank; NULL rank or none: NULL.

    One running maximum per rank replaces a stack.
    """
    ranked = df.withColumn("_r", rank)
    last = ranked.select("*", *[F.max(F.when(F.col("_r") == k, F.col("pos"))).over(_before()).alias(f"_l{k}") for k in range(ranks)])
    above = lambda r: F.lit(None).cast("int") if r == 0 else F.col("_l0") if r == 1 else F.greatest(*[F.col(f"_l{k}") for k in range(r)])
    parent = F.coalesce(*[F.when(F.col("_r") == r, above(r)) for r in range(1, ranks)])
    return last.withColumn("parent_pos", parent).drop("_r", *[f"_l{k}" for k in range(ranks)])


def compact_rank(rank: Column, doc: str = "doc") -> Column:
    """``rank`` renumbered 0.. over the ranks present in the document."""
    return F.array_position(F.array_sort(F.collect_set(rank).over(Window.partitionBy(doc))), rank) - 1


def _climb(state: DataFrame, join: Callable[[Column, Column], Column], value: str) -> DataFrame:
    """``state`` (doc, pos, up, value) carried on until no ``up`` is left: each round follows the ``up`` of ``up``.

    ``value`` covers the ancestors below ``up``; ``join`` puts that of ``up`` to one's own.
    """
    state = cut(state)
    # a chain of n nodes is climbed in as many rounds as n has binary digits
    for left in range(state.count().bit_length(), -1, -1):
        if state.where("up IS NOT NULL").isEmpty():
            return state
        if left == 0:
            raise ValueError("a node is its own ancestor")
        above = state.select("doc", F.col("pos").alias("up"), F.col("up").alias("_next"), F.col(value).alias("_above"))
        state = cut(state.join(above, ["doc", "up"], "left").select("doc", "pos", F.col("_next").alias("up"), join(F.col("_above"), F.col(value)).alias(value)))
    return state


def with_ancestors(df: DataFrame, levels: int = LEVELS, *columns: str) -> DataFrame:
    """``ancestors``: array of (pos, columns..) from the top down, by ``depth`` (0 at the top).

    Subtrees must be contiguous in ``pos``, as ``renumber`` makes them where nodes of unknown
    type stand between the parts of a tree. Trees deeper than ``levels`` are climbed by joins.
    """
    df = cut(df)
    deepest = df.agg(F.max("depth")).first()[0] or 0
    if deepest > levels:
        return with_chain(df, levels, *columns)
    held = F.struct("pos", *columns)
    last = [F.last(F.when(F.col("depth") == d, held), ignorenulls=True).over(_before()).alias(f"_a{d}") for d in range(max(deepest, 1))]
    chain = F.slice(F.array(*[F.col(f"_a{d}") for d in range(max(deepest, 1))]), F.lit(1), F.col("depth"))
    return df.select("*", *last).withColumn("ancestors", chain).drop(*[f"_a{d}" for d in range(max(deepest, 1))])


def with_chain(df: DataFrame, levels: int = LEVELS, *columns: str) -> DataFrame:
    """``ancestors`` as in ``with_ancestors``, by joins on the parent.

    For trees whose subtrees are not contiguous in ``pos``: nodes of unknown type at the top
    stand between the parts of others, and merged nodes have children from several places.
    """
    up = F.when(F.col("parent_pos") >= 0, F.col("parent_pos"))
    held = df.select("doc", F.col("pos").alias("_up"), up.alias("_next"), F.struct("pos", *columns).alias("_held"))
    chain = df.select("doc", "pos", up.alias("_up"), F.array().cast(f"array<{held.schema['_held'].dataType.simpleString()}>").alias("ancestors"))
    for _ in range(levels):
        chain = chain.join(held, ["doc", "_up"], "left").select("doc", "pos", F.col("_next").alias("_up"), F.when(F.col("_held").isNull(), F.col("ancestors")).otherwise(F.concat(F.array("_held"), "ancestors")).alias("ancestors"))
    # what is left to climb begins with the ancestor itself, since a round only takes over what lies above it
    left = chain.join(held.select("doc", "_up", "_held"), ["doc", "_up"], "left").select("doc", "pos", F.col("_up").alias("up"), F.when(F.col("_held").isNull(), F.col("ancestors")).otherwise(F.concat(F.array("_held"), "ancestors")).alias("ancestors"))
    whole = _climb(left, lambda above, own: F.when(above.isNull(), own).otherwise(F.concat(above, own)), "ancestors")
    return df.join(whole.select("doc", "pos", "ancestors"), ["doc", "pos"])


def renumber(df: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``pos`` and ``parent_pos`` from 0 in the order of the tree, children by their old places."""
    way = F.concat(F.transform("ancestors", lambda a: a["pos"]), F.array("pos"))
    placed = with_chain(df, levels).withColumn("_new", F.row_number().over(Window.partitionBy("doc").orderBy(way)) - 1).drop("ancestors")
    parents = placed.select("doc", F.col("pos").alias("parent_pos"), F.col("_new").alias("_parent"))
    out = placed.join(parents, ["doc", "parent_pos"], "left").withColumn("pos", F.col("_new")).withColumn("parent_pos", F.col("_parent"))
    return out.select(*df.columns)


def with_depth(df: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``depth`` of each node from its ``parent_pos``: the parents of each level are joined once.

    Levels are found by narrow joins on (doc, pos), which share one partitioning.
    """
    known = df.select("doc", "pos", F.when(F.col("parent_pos") >= 0, F.col("parent_pos")).alias("up"))
    step = known.select("doc", F.col("pos").alias("up"), F.col("up").alias("next"))
    depth = known.withColumn("depth", F.when(F.col("up").isNull(), 0).otherwise(1))
    for _ in range(levels - 1):
        depth = depth.join(step, ["doc", "up"], "left").select("doc", "pos", F.col("next").alias("up"), (F.col("depth") + F.when(F.col("next").isNotNull(), 1).otherwise(0)).alias("depth"))
    depth = _climb(depth, lambda above, own: own + F.coalesce(above, F.lit(0)), "depth")
    return df.join(depth.select("doc", "pos", "depth"), ["doc", "pos"])


def flatten_articles(df: DataFrame, article: str = "مادة", levels: int = LEVELS) -> DataFrame:
    """Children of an article hang on its nearest ancestor that is none; the order stays."""
    held = with_ancestors(df, levels, "type")
    proper = F.filter("ancestors", lambda a: a["type"] != article)
    return held.withColumn("parent_pos", F.try_element_at(proper, F.lit(-1))["pos"]).drop("ancestors")


def prune_structure(df: DataFrame, allowed: tuple[str, ...] = tuple(RANK), article: str = "مادة", levels: int = LEVELS, canonical: bool = False) -> DataFrame:
    """Without nodes of other types, root articles and numbers that are no digits, and without their subtrees.

    With ``canonical`` types lose their article and numbers become digits before they are judged.
    """
    if canonical:
        df = df.withColumn("type", canonical_type(F.col("type"))).withColumn("number", F.when(F.coalesce(F.trim("number"), F.lit("")) != "", clean_number(F.col("number"))).otherwise(F.col("number")))
    good = F.col("type").isin(*allowed) & ~((F.col("depth") == 0) & (F.col("type") == article)) & F.coalesce(F.trim("number"), F.lit("")).rlike(r"^\d*$")
    held = with_ancestors(df.withColumn("_good", F.coalesce(good, F.lit(False))), levels, "_good")
    return held.where(F.col("_good") & F.forall("ancestors", lambda a: a["_good"])).drop("_good", "ancestors")


def merge_duplicates(df: DataFrame, article: str = "مادة", levels: int = LEVELS) -> DataFrame:
    """Siblings of one type and number become one, articles excepted; texts are joined, children move over.

    A node is known by the types and numbers on the way to it (by its place if it is an
    article), so all levels merge in one aggregation. NULL and empty texts add nothing.
    """
    name = F.when(F.col("type") == article, F.concat(F.lit("#"), F.col("pos").cast("string"))).otherwise(F.concat("type", F.lit("/"), F.coalesce("number", F.lit(""))))
    held = with_ancestors(df.withColumn("_name", name), levels, "_name")
    way = F.transform("ancestors", lambda a: a["_name"])
    held = held.select("doc", "pos", "type", "number", "text", "depth", F.array_join(way, "\t").alias("_up"), F.array_join(F.concat(way, F.array("_name")), "\t").alias("_way"))
    filled = F.filter(F.array_sort(F.collect_list(F.when(F.coalesce("text", F.lit("")) != "", F.struct("pos", "text")))), lambda t: t.isNotNull())
    merged = held.groupBy("doc", "_way", "_up").agg(F.min("pos").alias("pos"), F.first("depth").alias("depth"), F.min_by("type", "pos").alias("type"), F.min_by("number", "pos").alias("number"), F.array_join(F.array_distinct(F.transform(filled, lambda t: t["text"])), "\n").alias("text"))
    parents = merged.select("doc", F.col("_way").alias("_up"), F.col("pos").alias("parent_pos"))
    return merged.join(parents, ["doc", "_up"], "left").select("doc", "pos", "parent_pos", "depth", "type", "number", "text")


def monotone_articles(df: DataFrame, article: str = "مادة") -> DataFrame:
    """One row per article number of a document: (doc, number, pos, text).

    Numbers are taken in ascending order; each keeps its first occurrence after the last
    kept one, else its last; the longest text wins, the kept one on ties. One fold over the
    sorted numbers of a document.
    """
    rows = df.where((F.col("type") == article) & F.trim("number").rlike(r"^\d+$")).select("doc", F.trim("number").alias("number"), "pos", F.coalesce("text", F.lit("")).alias("text"))
    by = rows.groupBy("doc", "number").agg(F.array_sort(F.collect_list("pos")).alias("places"))
    numbers = F.array_sort(F.collect_list(F.struct(F.col("number").cast("bigint").alias("n"), "number", "places")))

    def step(acc: Column, x: Column) -> Column:
        later = F.filter(x["places"], lambda p: p > acc["last"])
        kept = F.coalesce(F.try_element_at(later, F.lit(1)), F.element_at(x["places"], -1))
        return F.struct(kept.alias("last"), F.concat(acc["out"], F.array(F.struct(x["number"].alias("number"), kept.alias("pos")))).alias("out"))

    start = F.expr("named_struct('last', CAST(-1 AS INT), 'out', CAST(array() AS array<struct<number:string,pos:int>>))")
    chosen = by.groupBy("doc").agg(F.aggregate(numbers, start, step, lambda a: a["out"]).alias("out")).select("doc", F.inline("out").alias("number", "pos"))
    best = rows.join(chosen.withColumnRenamed("pos", "kept"), ["doc", "number"]).groupBy("doc", "number", "kept").agg(F.max_by("text", F.struct(F.length("text"), (F.col("pos") == F.col("kept")).cast("int"), -F.col("pos"))).alias("text"))
    return best.select("doc", "number", F.col("kept").alias("pos"), "text")


def deduplicate_articles(df: DataFrame, article: str = "مادة") -> DataFrame:
    """One row per article number: its first place and its longest text, the earlier on ties."""
    rows = df.where((F.col("type") == article) & F.col("number").isNotNull())
    return rows.groupBy("doc", "number").agg(F.min("pos").alias("pos"), F.max_by(F.coalesce("text", F.lit("")), F.struct(F.length(F.coalesce("text", F.lit(""))), -F.col("pos"))).alias("text"))


def attach_strays(df: DataFrame, article: str = "مادة") -> DataFrame:
    """Structural nodes deeper than their last structural sibling move under it; an article after a
    structural sibling moves under the last structural node before it."""
    siblings = Window.partitionBy("doc", "parent_pos").orderBy("pos")
    earlier = siblings.rowsBetween(Window.unboundedPreceding, -1)
    structural = F.col("type") != article
    out = df.withColumn("_rank", F.when(structural, _rank(F.col("type"))))
    out = out.withColumn("_least", F.min("_rank").over(earlier))
    # a sibling that lowers the running minimum, or equals it, is the one that later deeper ones hang on
    out = out.withColumn("_head", F.when(F.col("_rank") <= F.coalesce("_least", F.col("_rank")), F.col("pos")))
    out = out.withColumn("_on", F.max("_head").over(earlier)).withColumn("_last", F.max(F.when(structural, F.col("pos"))).over(_before()))
    moved = F.when(structural & (F.col("_rank") > F.col("_least")), F.col("_on")).when(~structural & F.col("_on").isNotNull(), F.col("_last")).otherwise(F.col("parent_pos"))
    return out.withColumn("parent_pos", moved).drop("_rank", "_least", "_head", "_on", "_last")


def rank_of(kind: Column) -> Column:
    """The rank of a structural type; NULL for others, which stand at the top and are nobody's parent."""
    return F.coalesce(*[F.when(kind == t, r) for t, r in RANK.items()])


def _rank(kind: Column) -> Column:
    return F.coalesce(rank_of(kind), F.lit(0))


def sort_children(df: DataFrame) -> DataFrame:
    """``ord``: place among siblings, by number (digits before words) where all are of one type, else as they stand."""
    siblings = Window.partitionBy("doc", "parent_pos")
    same = F.min("type").over(siblings) == F.max("type").over(siblings)
    value = F.trim("number").try_cast("bigint")
    keys = [F.when(F.col("_same"), value.isNull().cast("int")), F.when(F.col("_same"), value), F.when(F.col("_same") & value.isNull(), F.coalesce("number", F.lit("None"))), "pos"]
    return df.withColumn("_same", same).withColumn("ord", F.row_number().over(siblings.orderBy(*keys)) - 1).drop("_same")


def numbers_between(df: DataFrame, first: Column, last: Column, name: str) -> DataFrame:
    """``df`` with a row for each whole number from ``first`` to ``last``, however many; they are generated ``CHUNK`` at a time."""
    chunks = df.withColumns({"_first": first, "_last": last}).where("_first <= _last").withColumn("_at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_last") - F.col("_first")) / CHUNK))))
    start = F.col("_first") + F.col("_at") * CHUNK
    return chunks.withColumn(name, F.explode(F.sequence(start, F.least(start + (CHUNK - 1), F.col("_last"))))).drop("_first", "_last", "_at")


def fill_missing(df: DataFrame, kind: Column) -> DataFrame:
    """(doc, parent_pos, after_pos, type, number) of the numbers missing between neighbours of one type.

    Before the first of its siblings the gap starts at 1. Gaps of any width are filled.
    """
    siblings = Window.partitionBy("doc", "parent_pos").orderBy("pos")
    number = F.col("number").try_cast("bigint")
    rows = df.select("doc", "parent_pos", "pos", "type", number.alias("n"), F.lag("pos").over(siblings).alias("p"), F.lag("type").over(siblings).alias("t"), F.lag(number).over(siblings).alias("m"))
    start = F.when(F.col("p").isNull(), F.lit(0)).when(F.col("t") == F.col("type"), F.col("m"))
    rows = rows.where(kind).withColumn("start", start).where("n > start + 1").select("doc", "parent_pos", F.col("p").alias("after_pos"), "type", "start", "n")
    return numbers_between(rows, F.col("start") + 1, F.col("n") - 1, "number").select("doc", "parent_pos", "after_pos", "type", F.col("number").cast("string").alias("number"))


def drop_empty(df: DataFrame, article: str = "مادة") -> DataFrame:
    """Without nodes that are no articles and have neither text nor children; one pass."""
    parents = df.where("parent_pos IS NOT NULL").select("doc", F.col("parent_pos").alias("pos"), F.lit(True).alias("_held")).distinct()
    return df.join(parents, ["doc", "pos"], "left").where((F.col("type") == article) | (F.coalesce("text", F.lit("")) != "") | F.col("_held")).drop("_held")


def annexes(df: DataFrame, known: tuple[str, ...] = tuple(RANK), levels: int = LEVELS) -> DataFrame:
    """(doc, pos, title, text) of the topmost nodes of unknown type, with all texts below them."""
    held = with_chain(df.withColumn("_known", F.col("type").isin(*known)), levels, "_known")
    top = F.filter(F.concat("ancestors", F.array(F.struct("pos", "_known"))), lambda a: ~a["_known"])
    rows = held.withColumn("_top", F.try_element_at(top, F.lit(1))["pos"]).where("_top IS NOT NULL")
    title = F.max(F.when(F.col("pos") == F.col("_top"), F.array_join(F.filter(F.array("type", "number", "title"), lambda x: F.coalesce(x, F.lit("")) != ""), " ")))
    return rows.groupBy("doc", F.col("_top").alias("pos")).agg(title.alias("title"), F.expr("listagg(nullif(text, ''), '\\n') WITHIN GROUP (ORDER BY pos)").alias("text"))


def keep_deepest(df: DataFrame) -> DataFrame:
    """One node per (type, number) of a document: the deepest, then of longest text, then the first; texts are joined in order."""
    rows = df.where("number IS NOT NULL AND number <> ''")
    texts = F.array_sort(F.collect_list(F.when(F.coalesce("text", F.lit("")) != "", F.struct("pos", "text"))))
    return rows.groupBy("doc", "type", "number").agg(
        F.max_by("pos", F.struct("depth", F.length(F.coalesce("text", F.lit(""))), -F.col("pos"))).alias("pos"), F.array_join(F.array_distinct(F.transform(texts, lambda t: t["text"])), "\n").alias("text")
    )


def _once(df: DataFrame) -> DataFrame:
    """The nodes with one article per number, as ``monotone_articles`` chooses it, with its longest text."""
    kept = monotone_articles(df).select("doc", "pos", F.col("text").alias("_text"), F.lit(True).alias("_kept"))
    out = df.join(kept, ["doc", "pos"], "left").where((F.col("type") != "مادة") | F.col("_kept"))
    return out.withColumn("text", F.coalesce("_text", "text")).drop("_text", "_kept")


def filled_annexes(df: DataFrame, known: tuple[str, ...] = tuple(RANK)) -> DataFrame:
    """``annexes`` that hold any text."""
    return annexes(df, known).where(F.coalesce(F.trim("text"), F.lit("")) != "")


def post_process(df: DataFrame, profile: str = "pipeline") -> DataFrame:
    """The cleaning of a built tree: flatten, stray digits, merge, monotone articles, strays, monotone articles, prune.

    ``ui`` leaves out the digit repair, the second choice of articles and the pruning. Blank
    annexes and tables are left out by ``filled_annexes`` and ``documents.without_blank_tables``.
    """
    levels = len(RANK) + 2
    # each stage is written once: the joins of the next one read it several times
    out = flatten_articles(with_depth(cut(renumber(cut(df), levels)), levels), levels=levels)
    if profile != "ui":
        out = out.withColumn("number", drop_stray_digit(F.col("number")))
    out = cut(merge_duplicates(with_depth(cut(out.drop("depth")), levels), levels=levels))
    out = cut(renumber(out, levels))
    out = cut(attach_strays(_once(out)).drop("depth"))
    if profile == "ui":
        return with_depth(out, levels)
    return prune_structure(with_depth(cut(_once(out)), levels), levels=levels, canonical=True)
