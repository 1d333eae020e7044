import random

from raqim.llm import names, similar

ROWS = "global_id string, type string, text string, normalized string"


def test_band_equals_full_distance():
    def full(a, b):
        d = {}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                if not i or not j:
                    d[i, j] = i + j
                    continue
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rng = random.Random(1)
    for _ in range(4000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(7))) for _ in "ab")
        for k in (1, 2):
            assert similar.within(a, b, k) == (full(a, b) <= k), (a, b, k)


def test_segments_lose_no_pair(spark):
    rng = random.Random(2)
    values = {"".join(rng.choice("abcd") for _ in range(rng.randrange(4, 9))) for _ in range(400)}
    df = spark.createDataFrame([("s", v) for v in values] + [("t", "aaaa"), ("s", None)], "scope string, v string")
    got = {(r.value, r.other) for r in similar.similar_pairs(df, ("scope",), "v").collect()}
    assert got == {(a, b) for a in values for b in values if a < b and similar.within(a, b)}


def test_variants_are_linked(spark):
    given = ["Khadija", "Mohammed", "Youssef", "Rachid"]
    rows, n = [], 0
    for i, g in enumerate(given):
        for f in ("Kodnahkih", "Ben Dafqecfaw", "Toupzemqous", "Qihwibbouj", "Fopfisdih", "Vivmemkih"):
            rows += [(f"id-{g}-{f}", "PERSON" if i % 2 else "JUDGE", f"{g} {f}", None)] * 3
    variants = [("v1", "JUDGE", "Mme Kodnahkih, Khadija"), ("v2", "JUDGE", "KODNAHKIH Khadija"), ("v3", "JUDGE", "Khdija Kodnahkih"), ("v4", "JUDGE", "K. Kodnahkih"), ("v5", "JUDGE", "Khad. Kodnahkih"), ("v6", "JUDGE", "Khadija Kodnhakih"), ("v7", "JUDGE", "Khadija El Kodnahkih")]
    rows += [(a, b, c, None) for a, b, c in variants]
    rows += [("o1", "AGENCY", "Société Wittoscag Grands Travaux", None), ("o2", "AGENCY", "WITTOSCAG GRANDS TRAVAUX SARL", None), ("o3", "AGENCY", "Sté Wittosacg Grands Travaux", None)]
    rows += [(None, "PERSON", "x", None), ("n1", "PERSON", None, None), ("n2", "PERSON", "", ""), ("n3", "LAW", "القانون", None)]
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 AS id", "2 AS n")
    linked = names.link_names(df, ("PERSON", "JUDGE"), ("AGENCY",))
    entity = {r.global_id: r.entity for r in linked.collect()}
    assert {entity[v] for v, *_ in variants} == {entity["id-Khadija-Kodnahkih"]}
    assert entity["id-Youssef-Kodnahkih"] != entity["id-Khadija-Kodnahkih"] and len({entity[f"id-{g}-Kodnahkih"] for g in given}) == 4
    pairs = {(r.global_id_1, r.global_id_2) for r in names.linked_pairs(linked).collect()}
    assert len(pairs) == 8 * 7 // 2 + len([1 for a, b in pairs if a[0] == "o"]) and all(a < b for a, b in pairs)
    assert "n1" not in entity and "n3" not in entity
    assert names.link_names(df.limit(0), ("PERSON",), ("AGENCY",)).count() == 0


def test_a_family_written_first_is_no_given_name(spark, monkeypatch):
    given = ["Khadija", "Mohammed", "Youssef", "Rachid", "Latifa", "Bouchra"]
    families = ["Depwitxak", "Kodnahkih", "Toupzemqous", "Qihwibbouj", "Fopfisdih", "Vivmemkih", "Rojjedsoh"]
    rows = [(f"id-{g}-{f}", "PERSON", f"{g} {f}", None) for g in given for f in families]
    rows += [(f"r-{g}", "PERSON", f"Depwitxak {g}", None) for g in given[:5]]  # five partners, as many as some given names have
    rows += [("v1", "PERSON", "K. Depwitxak", None), ("v2", "PERSON", "Khdija Depwitxak", None)]
    df = spark.createDataFrame(rows, ROWS)
    for most in (names.MOST_FORMS, 2):
        monkeypatch.setattr(names, "MOST_FORMS", most)
        entity = {r.global_id: r.entity for r in names.link_names(df, ("PERSON",), ("AGENCY",)).collect()}
        assert all(entity[f"r-{g}"] == entity[f"id-{g}-Depwitxak"] for g in given[:5])
        assert entity["v1"] == entity["v2"] == entity["id-Khadija-Depwitxak"]


def test_generic_words_by_share(spark):
    beside = [("travaux", f"own{i}") for i in range(300)] + [("travaux", "societe")] * 300 + [("societe", f"own{i}") for i in range(300)]
    beside += [("woklakzaj", w) for w in ("societe", "travaux") for _ in range(60)] + [("woklakzaj", f"typo{i}") for i in range(20)]
    rows = beside + [(b, a) for a, b in beside]
    got = {r.form for r in names._generic(spark.createDataFrame(rows, "form string, partner string"), 20).collect()}
    assert got == {"travaux", "societe"}


def test_nickname_of_a_less_frequent_given_name(spark):
    made = lambda i: "".join(chr(98 + (i * k + k) % 19) for k in (1, 3, 5, 7, 11, 13, 17))
    families = list(dict.fromkeys(made(i).capitalize() for i in range(19)))
    common = [f"Z{'uo'[i % 2]}{chr(98 + i // 19)}{made(i)}" for i in range(60)]
    rows = [(f"m-{f}", "PERSON", f"Mohammed {f}", None) for f in common]
    rows += [(f"k-{f}", "PERSON", f"Khadija {f}", None) for f in families[:8]] * 3 + [(f"n-{f}", "PERSON", f"Doudou {f}", None) for f in families[:4]]
    entity = {r.global_id: r.entity for r in names.link_names(spark.createDataFrame(rows, ROWS), ("PERSON",), ("AGENCY",)).collect()}
    assert all(entity[f"n-{f}"] == entity[f"k-{f}"] for f in families[:4])
