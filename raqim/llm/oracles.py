"""SQL that gives the results of the queries where SQL can."""

from __future__ import annotations

_LABEL = r"\p{L}[\p{L}\p{M} ''’]{1,40}"
_FIELDS = rf"""
CREATE_FIELDS AS (
  SELECT article_id, lower(coalesce(number, '')) AS num, text,
    regexp_matches(text, '^[^\p{{L}}\p{{N}}]*{_LABEL}[:：]') AS starts,
    list_sort(list_filter(list_transform(
      string_split(regexp_replace(text, '(^|[\n\r\t|;؛,،•·/])([^\p{{L}}\p{{N}}\n]*{_LABEL}[:：])', chr(1) || '\2', 'g'), chr(1)),
      lambda f: regexp_replace(lower(f), '[^\p{{L}}\p{{N}}\p{{M}}]+', '', 'g')), lambda f: f <> '')) AS fields
  FROM articles
), canon AS (
  SELECT article_id, regexp_replace(num, '[^\p{{L}}\p{{N}}\p{{M}}]+', '', 'g') AS num,
    CASE WHEN starts AND len(fields) > 1 THEN array_to_string(fields, '|')
         ELSE regexp_replace(lower(text), '[^\p{{L}}\p{{N}}\p{{M}}]+', '', 'g') END AS c
  FROM fields
), long AS (SELECT *, replace(c, '|', '') AS l FROM canon WHERE length(replace(c, '|', '')) >= 60
), plainly AS (SELECT article_id, num, c, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}\p{{M}}]+', '', 'g') AS plain FROM long JOIN articles USING (article_id)
), kept AS (SELECT article_id, num, first_value(c) OVER (PARTITION BY num, plain ORDER BY len(string_split(c, '|')) DESC, c) AS c FROM plainly)
""".replace("CREATE_FIELDS", "fields")

SQL = {
    "p1_found": f"""
WITH {_FIELDS}
SELECT first_id, article_id FROM (
  SELECT article_id, min(article_id) OVER (PARTITION BY num, c) AS first_id FROM kept)
WHERE article_id <> first_id
""",
    "p1_groups": f"""
WITH {_FIELDS}
SELECT min(article_id) AS first_id, count(*) AS copies, count(DISTINCT coalesce(a.number, '') || chr(1) || a.text) AS layouts
FROM kept JOIN articles a USING (article_id) GROUP BY kept.num, c
""",
    "p7_found": r"""
WITH n AS (
  SELECT *, translate(number, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹０１２３４５６７８９', '012345678901234567890123456789') AS plain,
    regexp_replace(text, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g') AS bare
  FROM articles
), r AS (
  SELECT document_id, article_id, trust_rank, imported_at,
    nullif(regexp_extract(plain, '[0-9]+'), '') || CASE WHEN regexp_matches(lower(plain), 'مكرر|\bbis\b') THEN ' bis' ELSE '' END AS num,
    coalesce(regexp_matches(bare, '[.!?؟۔][»”"'')\]]*$') AND NOT regexp_matches(bare, '(\.\.|…)[»”"'')\]]*$') AND regexp_matches(bare, '\p{L}'), false) AS usable
  FROM n LEFT JOIN import_sources ON import_source = source_name
), w AS (
  SELECT *, count(*) OVER (PARTITION BY document_id, num) AS versions,
    row_number() OVER (PARTITION BY document_id, num ORDER BY usable DESC, trust_rank NULLS LAST, imported_at DESC NULLS LAST, article_id) AS place
  FROM r WHERE num IS NOT NULL AND document_id IS NOT NULL
)
SELECT document_id, num AS number, article_id FROM w WHERE versions > 1 AND place = 1
""",
    "p4_found": """
SELECT d.file_name, a.article_id FROM articles a LEFT JOIN documents d ON d.doc_id = a.document_id WHERE length(a.text) > 3000
""",
    # runs of 20 normalised words on both sides, joined as wholes
    "p9_found": r"""
WITH f AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM eval_items),
w AS (SELECT side, id, regexp_extract_all(regexp_replace(replace(translate(lower(strip_accents(nfc_normalize(text))), 'أإآٱ٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', 'اااا01234567890123456789'), 'ـ', ''), '[\p{M}\x{200B}-\x{200F}\x{AD}\x{2060}\x{FEFF}]', '', 'g'), '[\p{L}\p{N}]+') AS ws FROM f),
g AS (SELECT DISTINCT side, id, array_to_string(ws[k:k + 19], '') AS gram FROM (SELECT side, id, ws, unnest(range(1, len(ws) - 18)) AS k FROM w WHERE len(ws) >= 20))
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM g d JOIN g i ON d.side = 'd' AND i.side = 'i' AND d.gram = i.gram
""",
}
