import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from raqim.llm import confusables, leaks, moderation, scans, splitting, tokens
from raqim.llm.queries import tokenizer_file


def test_one_form(spark):
    values = ["Ｇhita", "Ghi​ta", "Ghita Ben", "Ghіta", "Бюро Журавль", "أڭلمان", "a  b", "كُتب", "٢٠٣٤", "ﺍلسلام", "یوسف", "éte", "", None, "Ghita", "ﻻ", "شدَّة", "x" * 100_000, "Ghita"]
    df = spark.createDataFrame(list(enumerate(values)), "entity_id bigint, text string").selectExpr("*", "text AS normalized", "1 AS k", "'z' AS batch")
    got = {r.entity_id: (r.text, r.text_changed) for r in confusables.unify(df, ("text",)).collect()}
    changed = {i for i, (_, c) in got.items() if c}
    assert changed == {0, 1, 2, 3, 9, 10, 11, 15}
    assert [got[i][0] for i in (0, 1, 3, 14)] == ["Ghita"] * 4 and got[10][0] == "يوسف" and got[11][0] == "éte" and got[15][0] == "لا" and got[13][0] is None
    assert confusables.changed_values(df, ("text", "normalized")).count() == 16
    assert confusables.unify(df.limit(0), ("text",)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab .\n؛é́", max_size=400), st.integers(12, 60), st.integers(0, 10))
def test_pieces(body, limit, overlap):
    spans = splitting.pieces(body, limit, overlap)
    assert all(e - s <= limit for s, e in spans)
    assert spans[0][0] == 0 and spans[-1][1] == len(body)
    for (_, end), (start, _) in zip(spans, spans[1:]):
        assert end - overlap <= start <= end


def test_split_table(spark):
    rows = [(1, "a. " * 2000), (2, None), (3, ""), (4, "x" * 9001), (5, "y" * 3000), (5, "y" * 3000)]
    got = splitting.split_texts(spark.createDataFrame(rows, "article_id bigint, text string").selectExpr("*", "1 AS k", "'' AS t")).collect()
    assert {r.article_id for r in got if r.pieces > 1} == {1, 4} and sum(r.article_id == 5 for r in got) == 2
    assert all(len(r.piece_text or "") <= 3000 for r in got)
    assert all(dict(rows)[r.article_id][r.start :].startswith(r.piece_text) for r in got if r.piece_text)
    assert splitting.split_texts(spark.createDataFrame([], "article_id bigint, text string")).count() == 0


@pytest.fixture(scope="module")
def ranks():
    return tokens.read_ranks(tokenizer_file("byte_bpe_50k.tiktoken"))


def test_ids_equal_the_public_library(spark, ranks):
    import tiktoken

    reference = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    alphabet = "aaab  \n\téÀ1٣ نصالمة'sll,.😀‍́中<|endoftext|>"
    texts = ["", None, "<|endoftext|>", " " * 5000, "a" * 20_000, "don't we'll"] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(300))) for _ in range(300)]
    got = {r.doc_id: r.ids for r in tokens.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "1 AS ids"), ranks).collect()}
    assert got == {i: None if t is None else reference.encode_ordinary(t) for i, t in enumerate(texts)}
    assert tokens.encode(spark.createDataFrame([], "doc_id bigint, text string"), ranks).collect() == []


def test_leaks_equal_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [a + b for a in ("mar", "tol", "قان", "مدي", "éco") for b in ("on", "i", "ون", "رية", "le")]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(12)] + [(90, "trop court"), (91, None), (92, "")]
    docs, expected = [], set()
    for d in range(60):
        i, body = rng.choice(items[:12])
        n = rng.choice((10, 19, 20, 25, 60))
        parts = body.split()
        a = rng.randrange(len(parts) - n + 1)
        quote = " ".join(parts[a : a + n])
        quote = rng.choice((quote, quote.upper(), quote.replace(" ", "\n"), quote.replace("ا", "أ"), unicodedata.normalize("NFD", quote), quote.replace(" ", ", ")))
        docs.append((d, f"zzz {quote} zzz"))
        if n >= 20:
            expected.add((d, i))
    docs += [(70, None), (71, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "9 AS item_id")
    found = leaks.find_leaks(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected
    assert all(r.quoted_words >= 20 and dict(docs)[r.doc_id][r.start_char : r.end_char].strip(" ,\n").startswith(dict(docs)[r.doc_id][4]) for r in found)
    small = leaks.find_leaks(df, spark.createDataFrame(items, "item_id bigint, text string"), shard_chars=1000).collect()
    assert sorted(map(tuple, small)) == sorted(map(tuple, found))
    assert leaks.find_leaks(df.limit(0), spark.createDataFrame(items, "item_id bigint, text string")).count() == 0
    assert leaks.find_leaks(df, spark.createDataFrame([], "item_id bigint, text string")).count() == 0


def test_every_quotation_is_reported():
    item = " ".join(f"mot{i}" for i in range(40))
    first, second = " ".join(item.split()[:22]), " ".join(item.split()[15:38])
    text = f"a {first} b {second} c {first} d"
    got = sorted(leaks.Matcher([(1, item)], 20).find(text), key=lambda g: g[2])
    places = leaks.originals(text, [g[2:] for g in got])
    assert [(g[0], g[1]) for g in got] == [(1, 22), (1, 23), (1, 22)] and [text[s:e].strip() for s, e in places] == [first, second, first]


BODY = ["Le conseil de discipline examine la pension homologuée avant de transférer la facture tardive à la commission.", "La société délégataire publie la requête détaillée sans préjudice de la provision gagée et de la saisie."]


def test_scan_repair(spark):
    rows = [(i, BODY[i % 2]) for i in range(60)]
    head = "Bulletin du Royaume"
    for i in range(100, 106):
        rows.append((i, f"Le con-\nseil de discipline exa-\n- 12 -\n{head} N° {i}\nmine la pension homologuée\n___ {head.upper()} ___\navant de transférer la facture tardive à la commission."))
    rows += [(200, "Le c0nseil de discipline examine la pension"), (201, "Tarifs :\nla pension\n208\nla facture\n331\nLe conseil."), (202, "Le conseil\n208\nde discipline"), (203, "- un\n- deux\n3) trois"), (204, None), (205, ""), (206, " \n ")]
    noise, fixed = scans.repair(spark.createDataFrame(rows, "article_id bigint, text string").selectExpr("*", "1 AS k", "2 AS pos"))
    got = {}
    for r in noise.collect():
        got.setdefault(r.article_id, set()).add(r.noise)
    assert got == {**{i: {"hyphen", "page", "header"} for i in range(100, 106)}, 200: {"char"}, 202: {"page"}}
    texts = {r.article_id: r.text for r in fixed.collect()}
    assert texts[100] == BODY[0] and texts[200].startswith("Le conseil") and texts[204] is None and texts[205] == "" and len(texts) == len(rows)
    empty, none = scans.repair(spark.createDataFrame([], "article_id bigint, text string"))
    assert empty.count() == none.count() == 0


def test_misread_words_by_context(spark):
    rows = [(i, "Le conseil publie la pension.") for i in range(40)] + [(100 + i, "Un agent public examine la requête.") for i in range(20)]
    rows += [(200 + i, "La taxe plus value, puis la cession.") for i in range(3)] + [(300 + i, "Le conseil siège, puis la cession.") for i in range(40)]
    rows += [(400, "Un agent piiblic examine la requête."), (401, "Le conseil piiblie la pension."), (402, "Une puis value, puis la cession.")]
    noise, fixed = scans.repair(spark.createDataFrame(rows, "article_id bigint, text string"))
    texts = {r.article_id: r.text for r in fixed.collect()}
    assert texts[400] == "Un agent public examine la requête." and texts[401] == "Le conseil publie la pension."
    assert texts[200] == dict(rows)[200]
    assert {r.article_id for r in noise.collect()} == {400, 401}


def test_severity_on_held_out_documents(spark):
    rng = random.Random(4)
    clean = [f"La commission {a} la requête {b}." for a in ("examine", "publie", "rejette", "suit") for b in ("locale", "tardive", "gagée", "commune")]
    insult = [f"{a} n'est qu'un pauvre {b}." for a in ("Ton chef", "Le juge", "Cet homme") for b in ("minable", "cr3tin", "i m b é c i l e", "abruuuuti")]

    def made(i, bad):
        parts = rng.sample(clean, 5)
        if bad:
            parts.insert(rng.randrange(5), rng.choice(insult))
        return i, " ".join(parts)

    docs = [made(i, i % 3 == 0) for i in range(400)] + [(400, None), (401, ""), (402, " ")]
    labels = [(i, int(i % 3 == 0) if rng.random() > 0.05 else 1 - int(i % 3 == 0)) for i in range(200)] + [(5, None), (999, 1), (0, 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS severity")
    out = {r.doc_id: r.severity for r in moderation.severity(df, spark.createDataFrame(labels, "doc_id bigint, abusive int")).collect()}
    wrong = sum((out[i] >= 1.0) != (i % 3 == 0) for i in range(200, 400))
    assert wrong <= 4 and out[400] == out[401] == 0.0 and len(out) == len(docs)
    none = moderation.severity(df, spark.createDataFrame([], "doc_id bigint, abusive int"))
    assert none.where("severity > 0").count() == 0


def test_titles_of_documents_often_objected_to_are_not_abusive(spark):
    rng = random.Random(3)
    made = lambda n: " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(n))
    rows = [(f"Avis sur le projet {i}. {made(8)}.", i < 60) for i in range(100)] + [(f"Texte relatif au bail {i}. {made(8)}.", i % 20 == 0) for i in range(300)]
    rows += [(f"{made(6)}. Vous êtes un pauvre crétin, {made(2)}.", True) for _ in range(40)]
    model = moderation.Ordinal.fit([(t, 2 * bad) for t, bad in rows])
    said = ("Avis sur le projet 7. Le reste est dit.", "Vous êtes un pauvre crétin, monsieur.", "Un pauvre homme.", "Texte relatif au bail 3.")
    assert [model.expected(t) >= 1.0 for t in said] == [False, True, False, False]
    # a text imported again and again is one document, and what it says stays its own
    docs = spark.createDataFrame([(i, "Le bail est signé.") for i in range(30)] + [(30, "Autre texte.")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(31)], "doc_id bigint, abusive int")
    assert moderation.sample_labels(docs, labels, 100, 10_000, "doc_id", "text", "abusive") == [("Le bail est signé.", 1), ("Autre texte.", 0)]
