"""Variant spellings of the names of persons and organisations.

Spellings are unified, freed of honorifics and parsed into (given, family), or for an
organisation into its distinctive words, with a vocabulary learned from all names: given
names are what stands before more different names than it follows, generic words what
stands beside rarer words often enough. Spellings that parse alike are one; further links come from

* one edit in the family or the given name (``similar``: pigeonhole segments, banded distance),
* nicknames, learned as forms whose families nearly always hold one certain given name,
* initials and cut-off given names, where only one person of the type and family fits.

A rarer form joins its most frequent neighbour, so two persons who share a family never
meet through an abbreviation. All joins are on equal keys.

Defined cases: null ids and null or empty names are left out; an id under two types counts
for each; repeated mentions only add to counts; a name that cannot be parsed stands for
itself; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raqim.llm.confusables import unify
from raqim.llm.similar import similar_pairs
from raqim.operators.lineage import cut

#: Given names and generic words are broadcast up to so many forms together, and joined by a shuffle beyond.
MOST_FORMS = 100_000
#: Of two spellings of one given name the better one stands before at least so many times as many different names.
SPELLING_RATIO = 5
#: Of what stands beside a generic word, by spellings, at least this share is rarer than it; beside a distinctive word nearly all is more frequent.
RARER_SHARE = 0.2

#: Forms of address before a name, and marks of legal form.
HONORIFICS = re.compile(r"^(?:السيدة|السيد|الأستاذة|الأستاذ|المستشارة|المستشار|ذة?\.|Monsieur|Madame|Mademoiselle|Maître|Mlle|Mme|Mr|Me|M\.)\s+(?=\S)", re.I)
ADDRESS = {"سي", "si", "sidi", "سيدي"}
SON = {"بن", "ben", "ould", "ابن"}
PARTICLES = SON | {"ait", "ايت", "el", "al", "بنت", "اولاد"}
ARTICLE = {"el", "al"}
LEGAL = {"société", "sté", "ste", "sarl", "sa", "شركة"}


def fold(text: str) -> str:
    """Case, accents, vowel marks and Arabic letters written alike made equal."""
    text = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if unicodedata.category(c) != "Mn")
    return text.translate({ord(a): b for a, b in zip("ةىٱـ", ["ه", "ي", "ا", ""])})


def words(text: str) -> list[tuple[str, bool]]:
    """Folded words, each with whether a full stop follows it."""
    text = re.sub(r"[-'’]", "", fold(text))
    return [(m[1], m[2] == ".") for m in re.finditer(r"([^\W_]+)(\.?)", text)]


def bare(name: str) -> str:
    """A unified name without its form of address; ``M.`` before a mere family is an initial."""
    name = name.strip()
    rest = HONORIFICS.sub("", name, count=1)
    if rest != name and name[:2] == "M." and len([w for w, _ in words(rest) if w not in PARTICLES]) < 2:
        return name
    return rest


def family(parts: list[str], given: frozenset[str] | set[str]) -> str:
    """The family without an inserted father's name or article."""
    for i in (3, 2):
        if len(parts) > i and parts[0] in SON and "".join(parts[1:i]) in given:
            parts = parts[i:]
            break
    if len(parts) > 1 and parts[0] in ARTICLE:
        parts = parts[1:]
    joined = "".join(parts)
    return joined[2:] if joined.startswith("ال") and len(joined) > 5 else joined


def parse(name: str, given: set[str] | frozenset[str], longest: int | None = None) -> list[tuple[str, str, str]]:
    """(kind, given, family) readings of a person's name: full, initial, cut or open; ``longest`` is the length of the longest given name."""
    marked = words(bare(name))
    if len(marked) > 2 and marked[0][0] in ADDRESS:
        marked = marked[1:]
    parts = [w for w, _ in marked]
    n = len(parts)
    for size in (3, 2, 1):
        if n > size:
            for head, rest in ((parts[:size], parts[size:]), (parts[-size:], parts[:-size])):
                if "".join(head) in given:
                    return [("full", "".join(head), family(rest, given))]
    if n > 1:
        for at, rest in ((0, parts[1:]), (n - 1, parts[:-1])):
            if len(parts[at]) == 1:
                return [("initial", parts[at], family(rest, given))]
        for at, rest in ((0, parts[1:]), (n - 1, parts[:-1])):
            if marked[at][1] and len(parts[at]) > 2:
                return [("cut", parts[at], family(rest, given))]
    whole = "".join(parts)
    most = max(map(len, given), default=0) if longest is None else longest
    for size in range(min(len(whole) - 4, most), 3, -1):  # a space lost or mistyped
        if whole[:size] in given:
            return [("full", whole[:size], family([whole[size:]], given))]
        if whole[-size:] in given:
            return [("full", whole[-size:], family([whole[:-size]], given))]
    if n < 2:
        return [("open", "", whole)] if whole else []
    return [("open", "".join(head), family(rest, given)) for head, rest in ((parts[:1], parts[1:]), (parts[:2], parts[2:]), (parts[-1:], parts[:-1]), (parts[-2:], parts[:-2])) if rest]


def parts_of(name: str) -> list[tuple[str, str]]:
    """(word as written, folded word) of an organisation's name."""
    return [(raw, w) for raw in re.sub(r"[-'’]", "", name).split() if (w := "".join(x for x, _ in words(raw)))]


def distinctive(name: str, generic: set[str] | frozenset[str]) -> str:
    """The words of an organisation's name that are neither generic nor a short capital abbreviation."""
    return "".join(w for raw, w in parts_of(name) if w not in generic and not (len(w) <= 3 and raw.isupper()))


def _leaders(pairs: DataFrame, least: int) -> DataFrame:
    """(form, n): forms that lead ``least`` partners or more, and more than they end, by partners and then by spellings."""
    side = lambda lead: F.struct(F.count_distinct(F.when(F.col("lead") == lead, F.col("partner"))).alias("n"), F.count_if(F.col("lead") == lead).alias("spellings"))
    counts = pairs.groupBy("form").agg(side("1").alias("leads"), side("0").alias("ends"))
    return counts.where((F.col("leads.n") >= least) & (F.col("leads") > F.col("ends"))).select("form", F.col("leads.n").alias("n"))


def _generic(pairs: DataFrame, least: int) -> DataFrame:
    """(form): words beside ``least`` different others or more, of which enough are rarer than the word."""
    pairs = cut(pairs.groupBy("form", "partner").agg(F.count("*").alias("spellings")))
    counts = cut(pairs.groupBy("form").agg(F.count("*").alias("n")))
    beside = pairs.join(counts.where(F.col("n") >= least), "form").join(counts.select(F.col("form").alias("partner"), F.col("n").alias("other")), "partner")
    rarer = F.sum(F.when(F.col("other") < F.col("n"), F.col("spellings")).otherwise(0))
    return beside.groupBy("form").agg((rarer / F.sum("spellings")).alias("share")).where(F.col("share") >= RARER_SHARE).select("form")


def _rows(function, schema: str):
    """A mapInArrow function that yields the tuples made of each row's values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [x for row in zip(*(c.to_pylist() for c in b.columns)) for x in function(*row)]
            names = [s.split()[0] for s in schema.split(", ")]
            yield pa.record_batch([pa.array([m[i] for m in made], pa.string()) for i in range(len(names))], names)

    return run


def _ends(name: str):
    """(form, partner, lead): what may be a given name at either end of a name, with the rest of it."""
    marked = words(bare(name))
    if any(stop for _, stop in marked):  # an abbreviation is no given name
        return
    parts = [w for w, _ in marked]
    if len(parts) > 2 and parts[0] in ADDRESS:
        parts = parts[1:]
    for size in (1, 2):
        if len(parts) > size and len(parts[0]) > 1 and parts[size - 1] not in PARTICLES and not (size == 2 and parts[0] in PARTICLES):
            yield "".join(parts[:size]), "".join(parts[size:]), "1"
        if len(parts) > size:
            yield "".join(parts[-size:]), "".join(parts[:-size]), "0"


def _asked(name: str, longest: int):
    """(name, form): every form that ``parse`` may look up for a name."""
    parts = [w for w, _ in words(bare(name))]
    whole = "".join(parts[1:] if len(parts) > 2 and parts[0] in ADDRESS else parts)
    forms = {"".join(parts[i : i + size]) for size in (1, 2, 3) for i in range(len(parts) - size + 1)}
    forms |= {x for size in range(4, min(len(whole), longest) + 1) for x in (whole[:size], whole[-size:])}
    for form in forms:
        yield name, form


def _beside(name: str):
    own = ["".join(x for x, _ in words(raw)) for raw in name.split()]
    for a in own:
        for b in own:
            if a != b:
                yield a, b


def _jump(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root): each node follows the edge to its weightiest neighbour until there is none weightier."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    weight = nodes.select(F.col("node").alias("b"), "weight")
    best = both.join(weight, "b").groupBy("a").agg(F.max(F.struct("weight", "b")).alias("up"))
    link = nodes.join(best, nodes["node"] == best["a"], "left").select("node", F.when(F.col("up") > F.struct("weight", F.col("node").alias("b")), F.col("up.b")).otherwise(F.col("node")).alias("root"))
    link = cut(link)
    while True:
        further = link.withColumnRenamed("root", "mid").join(link.select(F.col("node").alias("mid"), "root"), "mid").select("node", "mid", "root")
        further = cut(further)
        link = further.select("node", "root")
        if further.where("mid <> root").isEmpty():
            return link


def link_names(df: DataFrame, persons: tuple[str, ...], organisations: tuple[str, ...], key: str = "global_id", kind: str = "type", columns: tuple[str, ...] = ("text", "normalized"), least_families: int = 4, alias_share: float = 0.7) -> DataFrame:
    """(``key``, entity): ids with the same entity mean the same person or organisation."""
    values = F.explode(F.array(*[F.col(c) for c in columns])).alias("name")
    mentions = df.where(F.col(kind).isin(*persons, *organisations) & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(kind).alias("type"), values)
    # mentions are collapsed before anything else, so a frequent name is one row from here on
    counted = mentions.where("name IS NOT NULL AND name <> ''").groupBy("id", "type", "name").agg(F.count("*").alias("n"))
    one = unify(counted.withColumn("k", F.struct("id", "type", "n")), ("name",), key="k").select("k.id", "k.type", "k.n", F.regexp_replace(F.trim("name"), r"\s+", " ").alias("name"))
    names = cut(one.groupBy("id", "type", "name").agg(F.sum("n").alias("n")))
    person = F.col("type").isin(*persons)

    spelled = names.where(person).select("name").distinct()
    pairs = spelled.mapInArrow(_rows(_ends, "form string, partner string, lead string"), "form string, partner string, lead string")
    leaders = cut(_leaders(pairs, least_families))
    longest = leaders.agg(F.max(F.length("form"))).first()[0] or 0
    agencies = names.where(~person).select("name").distinct()
    beside = agencies.mapInArrow(_rows(_beside, "form string, partner string"), "form string, partner string")
    # generic words, those of legal form among them, and words one edit away that begin or end alike
    generic = _generic(beside, 20).union(df.sparkSession.createDataFrame([(fold(w),) for w in sorted(LEGAL)], "form string")).distinct()
    generic = cut(generic)
    said = cut(agencies.mapInArrow(_rows(lambda name: [(name, w) for _, w in parts_of(name)], "name string, form string"), "name string, form string"))
    near = similar_pairs(said.select("form"), (), "form", 4, generic.select(F.col("form").alias("value"))).where(F.length("value") > 4)
    alike = (F.left("value", F.lit(1)) == F.left("other", F.lit(1))) | (F.right("value", F.lit(1)) == F.right("other", F.lit(1)))
    generic = cut(generic.union(near.where(alike).select("value")).distinct())

    raw = names.select("id", "type", "name", person.alias("p"))
    if leaders.count() + generic.count() <= MOST_FORMS:
        held = frozenset(r.form for r in leaders.collect()), frozenset(r.form for r in generic.collect())
        raw = raw.withColumn("known", F.lit(None).cast("array<string>"))
    else:  # each name beside those of its forms that are given names or generic words
        held = None
        asked = spelled.mapInArrow(_rows(lambda name: _asked(name, longest), "name string, form string"), "name string, form string").join(leaders.select("form"), "form")
        told = asked.select("name", "form", F.lit(True).alias("p")).union(said.join(generic, "form").select("name", "form", F.lit(False)))
        raw = raw.join(told.groupBy("name", "p").agg(F.collect_set("form").alias("known")), ["name", "p"], "left").select("id", "type", "name", "p", "known")
    shared = df.sparkSession.sparkContext.broadcast(held)

    read_schema = "id string, type string, name string, kind string, given string, family string"

    def read(id_, type_, name, is_person, known):
        words_known = shared.value[0 if is_person else 1] if shared.value else frozenset(known or ())
        if is_person:
            return [(id_, type_, name, *r) for r in parse(name, words_known, longest) if r[2]]
        own = distinctive(name, words_known)
        return [(id_, type_, name, "full", "", own)] if own else [(id_, type_, name, "open", "", fold(name))]

    parsed = raw.mapInArrow(_rows(read, read_schema), read_schema)
    parsed = cut(parsed.join(names, ["id", "type", "name"]))
    full = parsed.where("kind = 'full'").groupBy("type", "given", "family").agg(F.sum("n").alias("weight"))
    full = cut(full.withColumn("node", F.concat_ws("\t", "type", "given", "family")))
    node = lambda g, f: F.concat_ws("\t", "type", g, f)

    # one edit in the family of the same given name, one edit in the given name of the same family
    family_edges = similar_pairs(full, ("type", "given"), "family", 5).select(node("given", "value").alias("a"), node("given", "other").alias("b"))
    # of two spellings of a given name one is far rarer; both common beside each other are two names
    given_pairs = similar_pairs(full.where("given <> ''"), ("type", "family"), "given")
    partners = lambda side, n: leaders.select(F.col("form").alias(side), F.col("n").alias(n))
    given_pairs = given_pairs.join(partners("value", "v"), "value", "left").join(partners("other", "o"), "other", "left")
    given_pairs = given_pairs.where(F.col("v").isNull() | F.col("o").isNull() | (F.least("v", "o") * SPELLING_RATIO < F.greatest("v", "o")))
    given_edges = given_pairs.select(node("value", "family").alias("a"), node("other", "family").alias("b"))

    # nicknames: forms whose families nearly always hold one certain, more frequent given name
    forms = full.where("given <> ''").groupBy("given").agg(F.count("*").alias("families"))
    # 3 shared families and twice as many of the proper name, so rarer forms of either kind make no pairs
    held = cut(full.join(forms.where("families >= 3"), "given").select("type", "family", "given", "families"))
    rare = held.select("type", "family", F.col("given").alias("nick"), F.col("families").alias("fn"))
    usual = held.where("families >= 6").select("type", "family", F.col("given").alias("proper"), F.col("families").alias("fp"))
    # whoever holds alias_share of a form's families holds one of any few more than the rest of them: of the least common ones
    heads = rare.join(usual.groupBy("type", "family").agg(F.count("*").alias("held")), ["type", "family"], "left").withColumn("held", F.coalesce("held", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("nick").orderBy("held", "type", "family"))
    heads = heads.withColumn("place", place).where(F.col("place") <= F.col("fn") - F.ceil(alias_share * F.col("fn")) + 1)
    tried = cut(heads).join(usual, ["type", "family"]).where("fp >= 2 * fn AND nick <> proper").select("nick", "proper", "fn", "fp").distinct()
    together = cut(tried).join(rare.drop("fn"), "nick").join(usual.drop("fp"), ["type", "family", "proper"]).groupBy("nick", "proper", "fn", "fp").agg(F.count("*").alias("both"))
    alias = together.where((F.col("both") >= alias_share * F.col("fn")) & (F.col("both") >= 3)).groupBy("nick").agg(F.max_by("proper", F.struct("both", "fp", "proper")).alias("proper"))
    alias = cut(alias)
    alias_edges = full.join(alias, full["given"] == alias["nick"]).select(F.col("node").alias("a"), node("proper", "family").alias("b"))
    alias_edges = alias_edges.join(full.select(F.col("node").alias("b")), "b", "left_semi")

    # names whose given part is unknown: one edit from the given name of a person of that family
    opened = parsed.where("kind = 'open' AND given <> ''").select("type", "given", "family", "id").distinct()
    tried = similar_pairs(full.where("given <> ''").select("type", "family", "given").union(opened.select("type", "family", "given")), ("type", "family"), "given", 3)
    tried = tried.union(tried.select("type", "family", F.col("other").alias("value"), F.col("value").alias("other")))
    hits = opened.join(tried.withColumnRenamed("value", "given"), ["type", "family", "given"]).withColumn("node", node("other", "family")).join(full.select("node", "weight"), "node")
    nick_hits = opened.join(alias.withColumnRenamed("nick", "given"), "given").withColumn("node", node("proper", "family")).join(full.select("node", "weight"), "node")
    best = hits.select("id", "type", "node", "weight").union(nick_hits.select("id", "type", "node", "weight")).groupBy("id", "type").agg(F.max_by("node", F.struct("weight", "node")).alias("node"))
    best = cut(best)

    # narrow tables, written so that no plan holds all the joins: large plans burden the driver
    edges = family_edges.union(cut(given_edges)).union(cut(alias_edges))
    roots = _jump(edges, full.select("node", "weight"))
    # initials and cut-off names join the only person they fit
    heads = roots.select(F.split("root", "\t").alias("r"), "root").distinct().select(F.col("r")[0].alias("type"), F.col("r")[1].alias("g"), F.col("r")[2].alias("family"), "root").where("g <> ''")
    sizes = F.explode(F.sequence(F.lit(1), F.length("g"))).alias("size")
    fits = heads.select("type", "family", "g", "root", sizes).select("type", "family", F.expr("substring(g, 1, size)").alias("given"), "root")
    only = fits.groupBy("type", "family", "given").agg(F.min("root").alias("root"), F.count("*").alias("persons")).where("persons = 1")
    short = parsed.where("kind IN ('initial', 'cut')").select("id", "type", "given", "family").distinct()
    short = short.join(cut(only), ["type", "family", "given"], "left").select("id", F.coalesce("root", node(F.concat("given", F.lit(".")), "family")).alias("entity"))

    whole = parsed.where("kind = 'full'").select("id", F.concat_ws("\t", "type", "given", "family").alias("node"), "n").join(roots, "node").select("id", F.col("root").alias("entity"), "n")
    rest = best.join(roots, "node").select("id", F.col("root").alias("entity"))
    alone = parsed.where("kind = 'open'").select("id", F.concat_ws("\t", "type", F.lit(""), F.lit("?"), "name").alias("entity"))
    ranked = whole.select("id", "entity", F.lit(3).alias("rank"), "n").union(rest.select("id", "entity", F.lit(2), F.lit(0))).union(short.select("id", "entity", F.lit(1), F.lit(0))).union(alone.select("id", "entity", F.lit(0), F.lit(0)))
    return ranked.groupBy("id").agg(F.max_by("entity", F.struct("rank", "n", "entity")).alias("entity")).withColumnRenamed("id", key)


def linked_pairs(entities: DataFrame, key: str = "global_id") -> DataFrame:
    """(``key``_1, ``key``_2) of ids with the same entity, the smaller first. Ids are one per spelling, so an entity has few."""
    a = entities.select("entity", F.col(key).alias(f"{key}_1"))
    b = entities.select("entity", F.col(key).alias(f"{key}_2"))
    return a.join(b, "entity").where(F.col(f"{key}_1") < F.col(f"{key}_2")).select(f"{key}_1", f"{key}_2")
