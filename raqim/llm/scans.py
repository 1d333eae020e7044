"""Repair of text from scanned pages: broken words, wrong characters, headers, page numbers.

* Running headers: lines are keyed without case, decoration and page number, their digits
  masked to a shape. Lines that run, that is come again within one text in different dress
  (rules, numbers, capitals), teach which shapes, which dresses and which opening words
  belong to headers, each by its share among all lines of the corpus that have it.
* Page numbers: marked ones by form; a bare number is one unless SQL windows over the
  remaining lines show it to be the amount that follows an item of a tariff.
* Broken words: a letter and a mark at a line end before a letter; a hyphen counts as real
  where the corpus has the compound more often than the joined word.
* Wrong characters: words are grouped by the skeleton of their glyphs (look-alikes share
  one); a rare form gives way to that frequent one which stands beside the same
  neighbours most often in the corpus, unless it stands there more often itself.
* Reflow: SQL windows over the kept lines choose what joins each line to the next.

All counts run over the whole corpus. Generators are the outer ones where their array is costly:
for others the optimizer adds a filter that computes the array again. Defined cases: null, empty and blank texts have no
noise and stay as they are; lists, tariffs, labelled fields and plain line breaks are no
noise; repeated rows each come out; extra columns are ignored; keys must be unique. Lines
are compared by 64-bit digests of their whole keys and shapes, whatever their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from raqim.operators.lineage import cut

DIGIT = "[0-9٠-٩۰-۹]"
#: A line that only gives a marked page number.
PAGE = rf"(?iu)^(?:[-–—]\s*{DIGIT}+\s*[-–—]?|\[\s*{DIGIT}+\s*\]|{DIGIT}+\s*/\s*{DIGIT}+|(?:pages?|p|ص|صفحة)\s*\.?\s*{DIGIT}+(?:\s*/\s*{DIGIT}+)?)$"
BARE = rf"^{DIGIT}+$"
#: A line that begins an item of a list.
ITEM = rf"^(?:[-–—•*]\s|\(?{DIGIT}+\s?[-)]|\(?\p{{L}}[-)])"
#: Marks that break a word at a line end: hyphens, soft hyphen, not sign, tatweel.
MARKS = r"\-‐‑¬­ـ"
BROKEN = rf"\p{{L}}\p{{M}}*[{MARKS}]+$"
#: Tables are broadcast up to this many characters, and joined by a shuffle beyond.
BROADCAST_CHARS = 16_000_000
#: A form must be so many times as frequent as the one it replaces: if that holds a digit or sign, and otherwise.
ODD_RATIO, LETTER_RATIO = 2, 8

#: Latin letters by the strokes they are taken for.
STROKES = (("m", "rri"), ("n", "ri"), ("u", "ii"), ("w", "vv"))

#: What each look-alike counts as.
_LATIN = {"1": "i", "!": "i", "|": "i", "l": "i", "j": "i", "0": "o", "5": "s", "@": "a", "6": "e", "c": "e", "à": "a", "â": "a", "ç": "e", "é": "e", "è": "e", "ê": "e", "ë": "e", "î": "i", "ï": "i", "ô": "o", "ù": "u", "û": "u", "ü": "u"}
_ARABIC = {
    "|": "ا", "1": "ل", "9": "و", "5": "ه", "أ": "ا", "إ": "ا", "آ": "ا", "ؤ": "و", "ئ": "ب", "ى": "ب", "ي": "ب", "ت": "ب", "ث": "ب", "ن": "ب",
    "ج": "ح", "خ": "ح", "ذ": "د", "ز": "ر", "ش": "س", "ض": "ص", "ظ": "ط", "غ": "ع", "ق": "ف", "ة": "ه",
}
_L_FROM, _L_TO = "".join(_LATIN), "".join(_LATIN.values())
_A_FROM, _A_TO = "".join(_ARABIC), "".join(_ARABIC.values())


#: Blanks at the ends of lines.
BLANKS = " \t\r\f\v\u00a0" + "".join(map(chr, range(0x2000, 0x2010))) + "\u2028\u2029\u202f\ufeff"
#: A header is one of several texts; of all lines of a shape, a dress or an opening at least this share must be known headers.
LEAST_TEXTS, SHAPE_SHARE, ALIKE_SHARE, DRESS_SHARE, OPENING_SHARE = 3, 0.15, 0.5, 0.5, 0.5


def skeleton(word: Column) -> Column:
    """The glyphs of a lower-cased word with look-alikes made equal."""
    arabic = F.translate(word, _A_FROM, _A_TO)
    latin = F.translate(word, _L_FROM, _L_TO)
    for one, strokes in STROKES:
        latin = F.replace(latin, F.lit(one), F.lit(strokes))
    return F.when(word.rlike(r"\p{IsArabic}"), arabic).otherwise(latin)


def tokens(text: Column) -> Column:
    """Lower-cased words, some of them empty; signs that stand for letters count as letters."""
    return F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}|!@]+")


def _masked(word: str) -> Column:
    """A number as ``#``; the comparison spares most words the pattern."""
    return F.when((F.col(word) < ":") & F.col(word).rlike(r"^\p{N}+$"), "#").otherwise(F.col(word))


def _if(test: Column, then: Column, other: Column) -> Column:
    """``then`` where ``test``; a cheap test spares most lines a pattern that would change nothing."""
    return F.when(test, then).otherwise(other)


def _lines(df: DataFrame) -> DataFrame:
    """Lines of the texts with line breaks: (k, whole, pos, s, item, mark, key, shape, dress), the last three of candidates for a header.

    ``mark`` is 1 of a bare number, 2 of a marked page number, else 0. ``key`` is the line without case, decoration and number at either end, ``shape`` the key
    with numbers masked (a digest, like the key), ``dress`` what the key leaves out.
    """
    s, low, inner, last, first = (F.col(c) for c in ("s", "low", "inner", "last", "first"))
    cand = (F.col("mark") == 0) & (s != "") & ~F.right(s, F.lit(1)).isin(*".؛;:,،!?؟-‐‑¬­ـ") & ~s.contains(":") & ~s.contains("：") & ~F.col("item") & s.rlike(r"(?<!\p{L})\p{L}{2,}+[^\p{L}].*?\p{L}{2}")
    ends = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
    number, ahead = rf"\s+(?:[-–—]|عدد|n°|no|p\.|ص)?\s*{DIGIT}+$", rf"^{DIGIT}+\s+[-–—]\s+"
    key = _if(first.rlike(DIGIT), F.regexp_replace(inner, ahead, ""), inner)
    key = _if(last.rlike(DIGIT), F.regexp_replace(key, number, ""), key)
    key = _if(inner.contains("  ") | inner.contains("\t"), F.regexp_replace(key, r"\s+", " "), key)
    shape = _if(F.col("key").rlike(DIGIT), F.regexp_replace("key", rf"{DIGIT}+(?:[./]{DIGIT}+)*", "#"), F.col("key"))
    # what stands around the key: signs, a number before a dash, the number of a page
    around = F.concat(F.regexp_extract(low, rf"^[^\p{{L}}\p{{N}}]*(?:{DIGIT}+(?:[./]{DIGIT}+)*\s+[-–—]\s+)?", 0), F.lit("a"), F.regexp_extract(inner, number, 0), F.regexp_extract(low, r"[^\p{L}\p{N}]+$", 0))
    plain = (inner == low) & ~first.rlike(DIGIT) & ~last.rlike(DIGIT)
    dress = F.concat(_if(plain, F.lit("a"), F.regexp_replace(around, rf"{DIGIT}+(?:[./]{DIGIT}+)*", "#")), _if((F.upper(s) == s) & (F.lower(s) != s), F.lit("^"), F.lit("")))
    return (
        df.where(F.col("t").contains("\n"))
        .select("k", F.xxhash64("t").alias("whole"), F.posexplode_outer(F.split("t", "\n")).alias("pos", "line"))
        .select("k", "whole", "pos", F.btrim("line", F.lit(BLANKS)).alias("s"))
        .withColumn("item", s.rlike(ITEM))
        .withColumn("mark", F.when(~s.rlike(DIGIT), 0).when(s.rlike(BARE), 1).when(s.rlike(PAGE), 2).otherwise(0).cast("tinyint"))
        .withColumn("low", F.when(cand, F.replace(F.replace(F.replace(F.lower(s), F.lit("أ"), F.lit("ا")), F.lit("إ"), F.lit("ا")), F.lit("آ"), F.lit("ا"))))
        .withColumn("inner", _if(F.concat(F.left(low, F.lit(1)), F.right(low, F.lit(1))).rlike(r"[^\p{L}\p{N}]"), F.regexp_replace(low, ends, ""), low))
        .withColumns({"first": F.left(inner, F.lit(1)), "last": F.right(inner, F.lit(1))})
        .withColumn("key", key)
        .withColumn("shape", shape)
        .withColumn("dress", F.when(low.isNotNull(), dress))
        .select("k", "whole", "pos", "s", "item", "mark", "key", "shape", "dress")
    )


def header_lines(lines: DataFrame) -> DataFrame:
    """(k, pos) of the lines that are running headers, from lines as ``_lines`` gives them, key and shape as digests.

    Lines that come again within one text, and not always in the same dress, are headers. So is

    * every line of a shape that does so in several texts, often enough for the shape, or
      that comes again in several texts and mostly does so,
    * every line in a dress (other than none) mostly worn by such lines,
    * every line that begins with words, one or more, that mostly begin such lines.

    Every share is one of all candidate lines of the corpus.
    """
    asked = lines.where("key IS NOT NULL")
    once = asked.groupBy("k", "key").agg(F.count("*").alias("c"), F.min(F.xxhash64("dress")).alias("d0"), F.max(F.xxhash64("dress")).alias("d1"))
    again = _bounded(once.where("c > 1").select("k", "key", (F.col("d0") != F.col("d1")).alias("run")))
    repeated = cut(asked.join(again, ["k", "key"]).select("k", "pos", "whole", "shape", "run"))
    by = repeated.groupBy("shape").agg(F.count("*").alias("r"), F.count_distinct(F.when(F.col("run"), F.col("whole"))).alias("runs"), F.count_distinct("whole").alias("texts"))
    tried = _bounded(by.where(F.col("texts") >= LEAST_TEXTS))
    many = asked.select("shape").join(tried.select("shape"), "shape").groupBy("shape").agg(F.count("*").alias("n"))
    shapes = many.join(tried, "shape").where(((F.col("runs") >= LEAST_TEXTS) & (F.col("r") >= SHAPE_SHARE * F.col("n"))) | (F.col("r") >= ALIKE_SHARE * F.col("n")))
    shapes = _bounded(shapes.select("shape", F.lit(True).alias("by_shape")))
    runs = _bounded(repeated.where("run").select("k", "pos", F.lit(True).alias("by_run")))
    known = asked.join(runs, ["k", "pos"], "left").join(shapes, "shape", "left").select("k", "pos", "whole", "dress", F.coalesce("by_run", "by_shape", F.lit(False)).alias("known"))
    texts = F.count_distinct(F.when(F.col("known"), F.col("whole")))
    share = F.count_if("known") / F.count("*")
    dresses = known.where("dress <> 'a'").groupBy("dress").agg(texts.alias("texts"), share.alias("share")).where((F.col("texts") >= LEAST_TEXTS) & (F.col("share") >= DRESS_SHARE))
    dresses = _bounded(dresses.select("dress", F.lit(True).alias("by_dress")))
    known = _bounded(known.join(dresses, "dress", "left").where("known OR by_dress").select("k", "pos", F.lit(True).alias("known")))
    return known.select("k", "pos").unionByName(_opened(asked.select("k", "pos", "whole", "s").join(known, ["k", "pos"], "left").withColumn("known", F.coalesce("known", F.lit(False)))))


def _opened(known: DataFrame) -> DataFrame:
    """(k, pos) of further lines whose first words mostly begin headers."""
    low = F.col("low")
    begins = F.left(low, F.lit(1)).rlike(r"\p{L}")
    norm = _if(begins, low, F.regexp_replace(low, r"^[^\p{L}]+", ""))
    norm = _if(low.rlike(DIGIT), F.regexp_replace(norm, rf"{DIGIT}+(?:[./]{DIGIT}+)*", "#"), norm)
    norm = _if(low.contains("  ") | low.contains("\t"), F.regexp_replace(norm, r"\s+", " "), norm)
    # a generator between the value and its uses, else the optimizer would compute it in each of them
    said = known.select("k", "pos", "whole", "known", F.lower("s").alias("low")).select("k", "pos", "whole", "known", F.explode_outer(F.array(norm)).alias("low")).withColumn("first", F.substring_index("low", " ", 1))
    words = "length(low) - length(replace(low, ' ', '')) + 1"
    digests = "transform(sequence(1, {}), i -> xxhash64(substring_index(low, ' ', i)))".format
    # openings that begin headers of several texts, of any number of words
    openings = said.where("known").select("whole", "first", F.posexplode_outer(F.expr(digests(words))).alias("at", "opening"))
    openings = _bounded(openings.groupBy("first", "at", "opening").agg(F.count("*").alias("e"), F.count_distinct("whole").alias("texts")).where(F.col("texts") >= LEAST_TEXTS))
    longest = openings.agg(F.max("at")).first()[0]
    if longest is None:
        return known.where(F.lit(False)).select("k", "pos")
    # of a line only the words are looked at that the longest opening has; those without its first word have none
    begun = said.where("NOT known").join(_bounded(openings.select("first").distinct()), "first", "left_semi")
    begun = cut(begun.select("k", "pos", F.explode_outer(F.expr(digests(f"least({words}, {longest + 1})"))).alias("opening")).join(openings.select("opening", "e"), "opening"))
    # of all lines that begin so, those known are e
    more = begun.groupBy("opening").agg(F.count("*").alias("n"))
    sure = openings.join(more, "opening").where(F.col("e") >= OPENING_SHARE * (F.col("e") + F.col("n"))).select("opening")
    return begun.join(_bounded(sure), "opening", "left_semi").select("k", "pos").distinct()


def _digests(lines: DataFrame) -> DataFrame:
    """``lines`` with key and shape as digests of 64 bits."""
    key = F.when(F.col("key").isNotNull(), F.xxhash64("key"))
    return lines.select("k", "whole", "pos", "s", "item", "mark", key.alias("key"), F.when(F.col("key").isNotNull(), F.xxhash64("shape")).alias("shape"), "dress")


def _marked(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((k, pos, kind) of headers and page numbers, (k, pos) of bare numbers that are amounts).

    Of two bare numbers in a row the second is a page number; one that follows an item of a
    tariff is its amount. Only texts with bare numbers go through these windows.
    """
    heads = _bounded(header_lines(lines).select("k", "pos", F.lit("header").alias("kind")))
    bare = _bounded(lines.where("mark = 1").select("k").distinct())
    s = F.col("s")
    first = lines.join(bare, "k", "left_semi").select("k", "pos", "s", "mark").join(heads, ["k", "pos"], "left").where("kind IS NULL AND mark < 2 AND s <> ''")
    order = Window.partitionBy("k").orderBy("pos")
    second = first.withColumn("bare", (F.col("mark") == 1) & ~((F.col("mark") == 1) & F.coalesce(F.lag("mark").over(order) == 1, F.lit(False))))
    second = second.where("mark = 0 OR bare")
    block = F.count_if(s.endswith(":") | s.endswith("：")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    inside = Window.partitionBy("k", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    place, numbers = F.count("*").over(inside) - 1, F.count_if("bare").over(inside)
    amounts = second.withColumn("block", block).withColumn("amount", (F.col("block") > 0) & (place == 2 * numbers)).where("bare AND amount").select("k", "pos")
    amounts = _bounded(amounts.withColumn("amount", F.lit(True)))
    pages = lines.where("mark > 0").select("k", "pos").join(heads.select("k", "pos"), ["k", "pos"], "left_anti").join(amounts, ["k", "pos"], "left_anti")
    return _bounded(heads.unionByName(pages.select("k", "pos", F.lit("page").alias("kind")))), amounts


def _packed(lines: DataFrame, marks: DataFrame, amounts: DataFrame) -> DataFrame:
    """(k, broken, held): of each text the kept lines in order, each with what joins it to the next.

    ``held`` has pos, s, how (0 last, 1 broken, 2 ends a paragraph, 3 runs on), and of a
    line broken at a plain hyphen x and y, its last word and the first of the next.
    """
    s, order = F.col("s"), Window.partitionBy("k").orderBy("pos")
    kept = lines.select("k", "pos", "s", "item").join(marks.select("k", "pos"), ["k", "pos"], "left_anti").join(amounts, ["k", "pos"], "left")
    kept = kept.withColumn("amount", F.coalesce("amount", F.lit(False))).withColumn("next", F.lead(F.struct("s", "item", "amount")).over(order))
    last = F.right("s", F.lit(1))
    broken = F.when(last.isin(*"-‐‑¬­ـ") & F.col("next.s").rlike(r"^[\p{L}\p{M}]"), F.col("s").rlike(BROKEN)).otherwise(False)
    ends = (s == "") | (F.col("next.s") == "") | F.col("amount") | F.col("next.amount") | last.isin(*".!?؟:：…") | _if(last.isin(*"»\"')]"), s.rlike(r"[.!?؟:：…][»\"')\]]+$"), F.lit(False)) | F.col("next.item")
    how = F.when(F.col("next").isNull(), 0).when(F.col("broken"), 1).when(ends, 2).otherwise(3)
    plain = F.col("broken") & s.rlike(r"[-‐‑]$") & ~s.rlike("ـ.?$")
    x, y = F.lower(F.regexp_extract("s", rf"([\p{{L}}\p{{M}}]+)[{MARKS}]+$", 1)), F.lower(F.regexp_extract("next.s", r"^[\p{L}\p{M}]+", 0))
    joined = kept.withColumn("broken", broken).select("k", "pos", "s", how.cast("tinyint").alias("how"), F.when(plain, x).alias("x"), F.when(plain, y).alias("y"))
    return joined.groupBy("k").agg(F.count_if(F.col("how") == 1).alias("broken"), F.sort_array(F.collect_list(F.struct("pos", "s", "how", "x", "y"))).alias("held"))


def _bigrams(rows: DataFrame) -> DataFrame:
    """(a, b, n): neighbouring words over the whole corpus; the first word of a text follows ''."""
    said = rows.select(tokens(F.col("t")).alias("w")).select("w", F.posexplode_outer("w").alias("at", "b")).where("b <> ''")
    return said.select(F.when(F.col("at") > 0, F.get("w", F.col("at") - 1)).otherwise("").alias("a"), "b").select(_masked("a").alias("a"), _masked("b").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))


def _replacements(bigrams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(suspects, words): rare forms, each with every frequent form of its skeleton, and all words with counts."""
    words = bigrams.groupBy("b").agg(F.sum("n").alias("n")).withColumnRenamed("b", "word")
    real = words.where(F.col("word").rlike(r"\p{L}") & (F.length("word") > 1)).withColumn("bone", skeleton(F.col("word")))
    odd = F.col("word").rlike(r"[0-9|!@]")
    # a form met once is ODD_RATIO times as frequent as none, so it is no candidate
    frequent = real.where(~odd & (F.col("n") >= ODD_RATIO)).select("bone", F.col("word").alias("right"), F.col("n").alias("often"))
    ratio = F.when(odd, ODD_RATIO).otherwise(LETTER_RATIO)
    return real.join(frequent, "bone").where((F.col("often") >= ratio * F.col("n")) & (F.col("right") != F.col("word")) & ~F.col("word").endswith("!")).select("word", "right", "often", odd.alias("odd")), words


def _kept(df: DataFrame) -> tuple[DataFrame, bool]:
    """``df`` as written to the shared folder, and whether that is small; its size is summed up while it is written.

    Each value counts 8 and its characters or elements.
    """
    wide = [F.coalesce(F.length(c) if kind == "string" else F.size(c), F.lit(0)) for c, kind in df.dtypes if kind == "string" or kind.startswith("array")]
    size = Observation()
    out = cut(df.observe(size, F.sum(sum(wide, F.lit(8 * len(df.columns))).cast("bigint")).alias("size")))
    return out, (size.get["size"] or 0) <= BROADCAST_CHARS


def _bounded(df: DataFrame) -> DataFrame:
    """``df`` as written, with a broadcast hint if that is small."""
    out, small = _kept(df)
    return F.broadcast(out) if small else out


def _met(texts: DataFrame, suspects: DataFrame, few: bool) -> DataFrame:
    """(k, b, right, often, odd, a, c): each suspect word b of the texts between its neighbours, with each candidate."""
    spoken = texts.select("k", tokens(F.col("t")).alias("w"))
    wrong = suspects.withColumnRenamed("word", "b")
    if few:  # few words are met, so the neighbours are looked up after the join
        met = spoken.select("k", "w", F.posexplode_outer("w").alias("at", "b")).join(F.broadcast(wrong), "b")
        return met.select("k", "b", "right", "often", "odd", F.when(F.col("at") > 0, F.get("w", F.col("at") - 1)).otherwise("").alias("a"), F.coalesce(F.get("w", F.col("at") + 1), F.lit("")).alias("c"))
    around = F.arrays_zip(F.concat(F.array(F.lit("")), "w").alias("a"), F.col("w").alias("b"), F.concat(F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), F.array(F.lit(""))).alias("c"))
    return spoken.select("k", F.inline_outer(around)).where("b <> ''").join(wrong, "b").select("k", "b", "right", "often", "odd", "a", "c")


def repair(df: DataFrame, key: str = "article_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(noise, repaired) of scanned texts.

    noise: (``key``, noise, n), a row for each kind of noise in a text. repaired:
    (``key``, text), every text as continuous paragraphs.
    """
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    bigrams = cut(_bigrams(rows))
    suspects, words = _replacements(bigrams)
    suspects, few = _kept(suspects)
    lines = cut(_digests(_lines(rows)))
    marks, amounts = _marked(lines)
    packed = cut(_packed(lines, marks, amounts))

    # a compound of the corpus is met as two neighbouring words, besides these breaks, more often than as one
    breaks = packed.select("k", F.inline("held")).where("x IS NOT NULL").select("k", "pos", "x", "y")
    asked = breaks.groupBy("x", "y", F.concat("x", "y").alias("joined")).agg(F.count("*").alias("breaks"))
    pairs = bigrams.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("n").alias("apart"))
    real = asked.join(pairs, ["x", "y"]).join(words.select(F.col("word").alias("joined"), "n"), "joined", "left").where(F.col("apart") - F.col("breaks") > F.coalesce("n", F.lit(0))).select("x", "y")
    compounds = _bounded(breaks.join(_bounded(real), ["x", "y"], "left_semi").groupBy("k").agg(F.collect_set("pos").alias("compounds")))
    flowed = packed.join(compounds, "k", "left").withColumn("compounds", F.coalesce("compounds", F.array().cast("array<int>")))
    hyphen = lambda e: (e["how"] == 1) & ~F.array_contains("compounds", e["pos"])
    piece = lambda e: (
        F.when(hyphen(e), F.regexp_replace(e["s"], f"[{MARKS}]+$", "")).when(e["how"] <= 1, e["s"]).when(e["how"] == 2, F.concat(e["s"], F.lit("\n"))).otherwise(F.concat(e["s"], F.lit(" ")))
    )
    flowed = flowed.select("k", F.array_join(F.transform("held", piece), "").alias("t"), (F.col("broken") - F.size("compounds")).alias("hyphen"))

    clean = flowed.select("k", "t").unionByName(rows.where(F.col("t").isNull() | ~F.col("t").contains("\n")))
    # texts that hold headers and page numbers only
    bare = rows.where(F.col("t").contains("\n")).select("k").join(packed.select("k"), "k", "left_anti").select("k", F.lit("").alias("t"))
    met = cut(_met(clean.where("t <> ''"), suspects, few))
    # how often each candidate, and the form itself elsewhere (right is NULL), stands beside the same neighbours
    around = met.groupBy("b", "a", "c").agg(F.collect_set(F.struct("right", "often")).alias("rights"), F.first("odd").alias("odd"))
    itself = F.array(F.struct(F.lit(None).cast("string").alias("right"), F.lit(None).cast("bigint").alias("often")))
    forms = around.select("b", "a", "c", F.inline(F.when(F.col("odd"), F.col("rights")).otherwise(F.concat("rights", itself)))).withColumn("as", F.coalesce("right", "b"))
    sides = F.array(F.struct(_masked("a").alias("x"), F.col("as").alias("y")), F.struct(F.col("as").alias("x"), _masked("c").alias("y")))
    beside = forms.select("b", "a", "c", "right", "often", F.inline(sides)).where("y <> ''").join(bigrams.select(F.col("a").alias("x"), F.col("b").alias("y"), "n"), ["x", "y"])
    best = beside.groupBy("b", "a", "c", "right", "often").agg(F.sum(F.when(F.col("right").isNull(), F.col("n") - 1).otherwise(F.col("n"))).alias("n"))
    chosen = best.groupBy("b", "a", "c").agg(F.max(F.when(F.col("right").isNotNull(), F.struct("n", "often", "right"))).alias("top"), F.max(F.when(F.col("right").isNull(), F.col("n"))).alias("own"))
    # a form that its own context supports more is a word of its own
    chosen = _bounded(chosen.where(F.col("top.n") >= F.coalesce("own", F.lit(0))).select("b", "a", "c", F.col("top.n").alias("n"), F.col("top.often").alias("often"), F.col("top.right").alias("right")))
    supported = met.select("k", "b", "a", "c").join(chosen, ["b", "a", "c"]).groupBy("k", "b").agg(F.max(F.struct("n", "often", "right")).alias("top")).groupBy("k").agg(F.collect_set(F.struct("b", F.col("top.right").alias("right"))).alias("wrong"))
    supported, some = _kept(supported)

    noise = flowed.where("hyphen > 0").select("k", F.lit("hyphen").alias("noise"), F.col("hyphen").alias("n"))
    noise = noise.unionByName(marks.groupBy("k", F.col("kind").alias("noise")).agg(F.count("*").alias("n"))).unionByName(supported.select("k", F.lit("char").alias("noise"), F.size("wrong").cast("bigint").alias("n")))
    fixed = F.aggregate(
        F.coalesce("wrong", F.expr("CAST(array() AS array<struct<b:string,right:string>>)")),
        F.col("t"),
        lambda t, x: F.regexp_replace(t, F.concat(F.lit(r"(?iu)(?<![\p{L}\p{M}\p{N}])\Q"), x["b"], F.lit(r"\E(?![\p{L}\p{M}\p{N}])")), x["right"]),
    )
    return noise.withColumnRenamed("k", key), clean.unionByName(bare).join(F.broadcast(supported) if some else supported, "k", "left").select(F.col("k").alias(key), fixed.alias(text))
