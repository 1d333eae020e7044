import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from raqim.llm import survivors
from raqim.llm.layout_duplicates import distinct_records, layout_groups

SCHEMA = "article_id bigint, number string, text string"
LONG = "Toutefois, l'unité administrative évalue la subvention tardive et coordonne la déclaration préalable."


def brute(rows):
    def letters(t):
        return "".join(c for c in t.lower() if unicodedata.category(c)[0] in "LNM")

    groups = {}
    for i, n, t in rows:
        if t is None or len(letters(t)) < 60:
            continue
        fields = [f for f in re.split(r"[\n|;]", t)]
        key = sorted(map(letters, fields)) if len(fields) > 1 and all(":" in f for f in fields) else letters(t)
        groups.setdefault((letters(n or ""), str(key)), []).append(i)
    return {(min(g), i) for g in groups.values() for i in g if i != min(g)}


def test_layouts_that_hide_a_field(spark):
    a = "Partie concernée: l'administration | Montant: 95867 dirhams | Délai: 222 jours | Référence:…"
    rows = [(1, "1", a), (2, "1", a.replace("Référence:…", "Référence…")), (3, "1", a.replace(" ", "\t")), (4, "1", " | ".join(a.split(" | ")[::-1])), (5, "2", a)]
    members, groups = layout_groups(spark.createDataFrame(rows, SCHEMA))
    assert {(r.first_id, r.article_id) for r in members.collect()} == {(1, i) for i in (1, 2, 3, 4)}
    assert sorted((r.first_id, r.copies) for r in groups.collect()) == [(1, 4), (5, 1)]


def test_labels_of_any_length_and_kind(spark):
    long = "Montant de la contribution due par l'exploitant agricole de la commune"
    for label in (long, "Sous-total", "N° du dossier", "Réf. (ancienne)", "1re tranche", "N"):
        fields = [f"{label}: 54932 dirhams", "Délai: 20 jours", "Objet: la saisie commune de la requête préalable"]
        rows = [(i, "7", " | ".join(fields[i:] + fields[:i])) for i in range(3)] + [(3, "7", " | ".join(fields).replace("54932", "54933"))]
        members, _ = layout_groups(spark.createDataFrame(rows, SCHEMA))
        assert {(r.first_id, r.article_id) for r in members.collect()} == {(0, 0), (0, 1), (0, 2)}, label


def test_chains_of_layouts(spark):
    # the order that one layout shows in full is hidden in the next, which agrees with a third by its fields
    fields = [f"Champ {c}{c}: la valeur {c} du dossier" for c in "abcdefgh"]
    rows = []
    for i in range(8):
        turned = fields[i:] + fields[:i]
        hidden = turned[0].replace(":", "") + "; " + turned[1]
        rows += [(10 * i, "1", "; ".join([turned[2], hidden, *turned[3:]])), (10 * i + 1, "1", "; ".join([*turned[3:], turned[2], hidden]))]
        rows.append((10 * i + 2, "1", "; ".join([*turned[3:], turned[2], *turned[:2]])))
    members, groups = layout_groups(spark.createDataFrame(rows, SCHEMA))
    assert {(r.first_id, r.article_id) for r in members.collect()} == {(0, r[0]) for r in rows}
    assert [(r.first_id, r.copies, r.layouts) for r in groups.collect()] == [(0, 24, 24)]


def test_every_record_once(spark):
    grown = "İ" * 40  # 80 letters and marks in lower case
    rows = [(1, "5", LONG), (2, "5", LONG.upper()), (3, "5", "court"), (4, "5", "court"), (5, "5", None), (6, None, ""), (7, "5", LONG), (8, "9", grown), (9, "9", grown + ".")]
    out = {r.article_id: (r.number, r.text, r.copies, r.layouts) for r in distinct_records(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {1: ("5", LONG, 3, 2), 3: ("5", "court", 1, 1), 4: ("5", "court", 1, 1), 5: ("5", None, 1, 1), 6: (None, "", 1, 1), 8: ("9", grown, 2, 2)}


def test_layouts_equal_brute_force(spark):
    fields = ["Montant: 54932 dirhams", "Délai: 20 jours", "Référence: 227345/63", "Objet: la saisie commune de la requête"]
    rows = [(1, "5", LONG), (2, "(5)", LONG.upper()), (3, "5", LONG.replace(" ", " \n ")), (4, "6", LONG), (5, None, LONG), (6, "", LONG + "!"), (7, "5", LONG), (8, "5", LONG + "é"), (9, "5", "short"), (10, "5", None), (11, "5", "")]
    rng = random.Random(1)
    for i in range(12, 24):
        rng.shuffle(fields)
        rows.append((i, "7", rng.choice((" | ", "\n", "; ")).join(fields) + "."))
    rows.append((24, "7", "\n".join(f.replace("54932", "54933") for f in fields)))
    rows += [(25 + i, "9", "س" * 200_000) for i in range(2)] + [(40, "5", LONG)] * 2
    members, groups = layout_groups(spark.createDataFrame(rows, SCHEMA))
    got = {(r.first_id, r.article_id) for r in members.where("article_id <> first_id").collect()}
    assert got == brute(rows)
    assert {r.first_id: r.copies for r in groups.collect()}[1] == 6


def test_empty_and_clashing(spark):
    members, groups = layout_groups(spark.createDataFrame([], SCHEMA))
    assert members.count() == groups.count() == 0
    rows = spark.createDataFrame([(1, "5", LONG, "a", 1), (2, "5", LONG, "b", 2)], SCHEMA + ", key string, n int")
    assert layout_groups(rows)[0].count() == 2


def test_hot_group(spark):
    rows = spark.range(20_000).select(F.col("id").alias("article_id"), F.lit("1").alias("number"), F.when(F.col("id") % 3 == 0, F.lit(LONG)).otherwise(F.concat(F.lit(LONG), F.col("id").cast("string"))).alias("text"))
    members, _ = layout_groups(rows)
    assert members.count() == 6667 and members.select("first_id").distinct().count() == 1


VERSIONS = "article_id bigint, document_id bigint, number string, text string, rank bigint, at bigint"


def best(spark, rows, **k):
    df = spark.createDataFrame(rows, VERSIONS)
    out = survivors.best_version(df, {"document_id": F.col("document_id"), "number": survivors.article_number(F.col("number"))}, order=(F.col("rank"), -F.col("at")), **k)
    return {(r.document_id, r.number): (r.article_id, r.versions) for r in out.collect()}


def test_trust_time_and_key_decide_among_usable(spark):
    rows = [
        (1, 1, "المادة ٥", "Un texte.", 3, 9), (2, 1, "5", "Un autre texte.", 2, 1), (3, 1, "(5)", "Coupé avant la fi", 1, 9), (4, 1, "5 bis", "Seul.", 1, 1), (5, 1, "5.", "N/A", 1, 9),
        (6, 2, "7", "Egal.", None, 3), (7, 2, "7", "Egal.", None, 3), (8, 2, None, "x.", 1, 1), (9, 3, "1", None, 1, 1), (10, 3, "1", "", 1, 2), (11, 4, "2", "Vieux.", 1, 1), (12, 4, "2", "Neuf.", 1, 2), (13, 4, "2", "...", 1, 3), (14, 4, "2", "؟؟؟", 1, 3),
    ]
    assert best(spark, rows) == {(1, "5"): (2, 4), (2, "7"): (6, 2), (3, "1"): (10, 2), (4, "2"): (12, 4)}
    assert best(spark, []) == {}


def test_consensus_takes_the_common_version(spark):
    texts = ["le chat noir dort ici.", "le chat gris dort ici.", "le chien noir dort ici.", "le chat noir dort ici ce soir."]
    rows = [(i, 1, "1", t, 1, 0) for i, t in enumerate(texts)]
    assert best(spark, rows, policy="votes") == {(1, "1"): (0, 4)}


def test_a_text_that_another_carries_on_is_cut_off(spark):
    whole = "Le conseil statue selon l'art. 5 du code. Il publie."
    rows = [(1, 1, "1", "Le conseil statue selon l'art.", 1, 9), (2, 1, "1", whole, 2, 1), (3, 1, "1", "Le conseil statue.", 3, 1)]
    rows += [(4, 2, "1", "Le conseil statue.", 1, 9), (5, 2, "1", "Le conseil statue. Il publie.", 2, 1)]  # a shorter version, and whole
    rows += [(6, 3, "1", "Le cons.", 1, 1), (7, 3, "1", "Le conseil statue selon l'art.", 2, 1), (8, 3, "1", whole, 3, 1)]
    assert best(spark, rows) == {(1, "1"): (2, 3), (2, "1"): (4, 2), (3, "1"): (8, 3)}


def test_large_groups(spark):
    rows = [(i, 1, "1", f"mot {i} et la suite du texte.", 5, i) for i in range(600)] + [(600, 1, "1", "le plus sûr.", 1, 0)]
    assert best(spark, rows) == {(1, "1"): (600, 601)}


def test_alignment(spark):
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("abcdefgh") + str(rng.randrange(n)) for _ in range(rng.randrange(300))] for n in (rng.choice((1, 3, 40)),) * 2)
        b = rng.choice((b, a[:40] + b[:5] + a[60:], a[::-1], a[:10]))
        parts = survivors.differing(a, b)
        out, at = [], 0
        for i, j, k, l in parts:
            out += a[at:i] + b[k:l]
            at = j
        assert out + a[at:] == b
        assert survivors.edited(a, survivors.differences(a, b)) == b
    long = [str(i) for i in range(200_000)]
    assert survivors.differing(long, long[:1000] + ["x"] + long[1001:150_000]) == [(1000, 1001, 1000, 1001), (150_000, 200_000, 150_000, 150_000)]


def test_votes_do_not_depend_on_the_size_of_the_group(spark):
    words = "a b c d e f g h".split()
    texts = [(" ".join(words[:i % 8] + [f"x{i}"] + words[i % 8 + 1 :]) + " fin.", 1 + i % 2) for i in range(40)] + [("a b c d e f g h fin.", 1)]
    texts += [(f"tout autre texte {i} que voici.", 3) for i in range(5)] + [("a b c d e f g h", 60)]  # the last has no end and no vote
    rows = [(k, t) for k, t in enumerate(t for t, n in texts for _ in range(n))]
    last = next(k for k, t in rows if t == "a b c d e f g h fin.")
    made = [(k, 1, "1", t, 1, 0) for k, t in rows]
    assert best(spark, made, policy="votes")[1, "1"] == (last, len(rows))
    assert best(spark, [(1, 1, "1", None, 1, 0), (2, 1, "1", "", 1, 0)], policy="votes") == {(1, "1"): (1, 2)}
    base = "le chat dort".split()
    for other in ("un le chat noir dort ici ce soir", "chat", "", "le chat dort"):
        assert survivors.edited(base, survivors.differences(base, other.split())) == other.split()


@pytest.mark.parametrize("text, good", [("Fin.", True), ("Fin (suite)", False), ("Fin…", False), ("Fin...", False), (" ", False), ("؟؟؟", False), ("نعم؟", True), ("« Oui. »", False), ("«Oui.»", True)])
def test_usable(spark, text, good):
    assert spark.createDataFrame([(text,)], "t string").select(survivors.usable(F.col("t")).alias("u")).first().u is good
