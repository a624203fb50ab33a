"""SQL that states what the Portuguese pack finds: number words, plurals, owned units, learned forms and names heard."""

from __future__ import annotations

from termloom.functions.languages import PORTUGUESE

_NUMBERS = "MAP {" + ", ".join(f"'{w}': '{d}'" for w, d in PORTUGUESE.numbers.items()) + "}"
_COMMON = "[" + ", ".join(f"'{w}'" for w in sorted(PORTUGUESE.common)) + "]"
_PLURALS = " OR ".join(f"(w.run LIKE '%{ending}' AND f.form = left(w.run, length(w.run) - {len(ending)}) || '{single}')" for ending, single in PORTUGUESE.plurals)

#: What every transcript of the query ends in.
SUFFIX = " || ' . cresceu ' || coalesce(d.n_chars, 0) || ' B com in dois'"


def _sound(folded: str) -> str:
    """Sound classes without vowels and doubles; a letter that two matches share is met by the second pass."""
    flat = f"replace({folded}, ' ', '')"
    for _ in range(2):
        flat = rf"regexp_replace({flat}, '[lu]([bcdfghjklmnpqrstvwxz])', 'w\1', 'g')"
    flat = f"regexp_replace(regexp_replace(regexp_replace({flat}, '[sc]', 's', 'g'), '[gj]', 'j', 'g'), '[aeiouy]', '', 'g')"
    return f"array_to_string(list_reduce(list_prepend([''], list_transform(string_split({flat}, ''), lambda c: [c])), lambda a, c: CASE WHEN a[len(a)] = c[1] THEN a ELSE list_concat(a, c) END), '')"


#: Continues the CTEs ``lines``, ``texts`` (with ``SUFFIX``) and ``tokens``.
ORACLE = rf"""
    forms(form, term, origin) AS (
        VALUES ('thintion', 'Thintion', 'term'), ('thanedble', 'Thanedble', 'term'), ('thonth', 'Thanedble', 'alias'), ('bi', 'bi', 'term'), ('bilhao', 'bi', 'alias'), ('in2', 'bi', 'variant'),
               ('thineation', 'Thintion', 'variant'), ('thndble', 'Thanedble', 'alias')
    ), parts AS (
        SELECT *, regexp_replace(strip_accents(lower(token)), '[^a-z0-9$ ]+', ' ', 'g') AS part FROM tokens
    ), ahead AS (
        SELECT *, lead(part) OVER w AS p1, lead(part, 2) OVER w AS p2, lead("end") OVER w AS e1, lead("end", 2) OVER w AS e2, lead(closes) OVER w AS c1 FROM parts WINDOW w AS (PARTITION BY doc_id ORDER BY i)
    ), spread AS (
        SELECT doc_id, i, 1 AS n, start, "end", trim(part) AS plain FROM ahead
        UNION ALL SELECT doc_id, i, 2, start, e1, trim(part || ' ' || p1) FROM ahead WHERE e1 IS NOT NULL AND NOT closes
        UNION ALL SELECT doc_id, i, 3, start, e2, trim(part || ' ' || p1 || ' ' || p2) FROM ahead WHERE e2 IS NOT NULL AND NOT closes AND NOT c1
    ), counted AS (
        SELECT *, CASE WHEN len(list_filter(string_split(plain, ' '), lambda x: map_contains({_NUMBERS}, x))) = 0 THEN plain ELSE array_to_string(list_reduce(list_prepend(['#'], list_transform(string_split(plain, ' '), lambda x: [x])),
               lambda a, x: CASE WHEN NOT map_contains({_NUMBERS}, x[1]) THEN list_concat(a, x)
                                 WHEN regexp_matches(a[len(a)], '[a-z]$') AND NOT list_contains({_COMMON}, a[len(a)]) THEN list_concat(a[:len(a) - 1], [a[len(a)] || {_NUMBERS}[x[1]]])
                                 ELSE list_concat(a, [{_NUMBERS}[x[1]]]) END)[2:], ' ') END AS folded FROM spread
    ), every AS (SELECT *, trim(regexp_replace(folded, ' +', ' ', 'g')) AS run FROM counted), named AS (
        SELECT w.doc_id, w.start, w."end", f.term, CASE f.origin WHEN 'term' THEN 'term:exact' ELSE 'term:' || f.origin END AS rule, CASE f.origin WHEN 'variant' THEN 'correction' ELSE 'alias' END AS kind, 'high' AS band, 100 AS score
        FROM every w JOIN forms f ON w.folded = f.form WHERE length(w.folded) >= 2
        UNION ALL SELECT w.doc_id, w.start, w."end", f.term, 'term:alias', 'alias', 'high', 100
        FROM every w JOIN forms f ON f.origin <> 'variant' AND ({_PLURALS}) WHERE w.n = 1 AND w.run NOT LIKE '% %' AND w.run NOT IN (SELECT form FROM forms)
    ), units AS (
        SELECT doc_id, (strpos(text, ' . cresceu ') + 10)::INT AS start, (length(text) - length(' com in dois'))::INT AS "end", 'bi' AS term, 'unit' AS rule, 'correction' AS kind, 'high' AS band, 100 AS score FROM texts
    ), taken AS (SELECT * FROM named UNION ALL SELECT * FROM units), codes AS (
        SELECT term, {_sound("form")} AS code FROM forms WHERE origin <> 'variant'
    ), heard AS (SELECT *, {_sound("folded")} AS sound FROM every WHERE n <= 2), near AS (
        SELECT DISTINCT h.sound, c.term, c.code, list_transform(string_split(h.sound, ''), lambda x: list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length(c.code) + 1), lambda k: CASE WHEN c.code[k] = x THEN 1::BIGINT << (k - 1) ELSE 0 END)), lambda a, b: a | b)) AS places,
               (1::BIGINT << length(c.code)) - 1 AS whole
        FROM (SELECT DISTINCT sound FROM heard WHERE length(sound) >= 5) h JOIN codes c ON length(c.code) >= 5 AND abs(length(h.sound) - length(c.code)) <= 2
    ), measured AS (
        SELECT sound, term, 200.0::DOUBLE * (length(code) - bit_count(list_reduce(list_prepend(whole, places), lambda v, u: ((v + (v & u)) | (v - (v & u))) & whole))) / (length(sound) + length(code)) AS ratio FROM near
    ), best AS (
        SELECT h.*, max({{'ratio': m.ratio, 'term': m.term}}) AS b FROM heard h JOIN measured m ON m.sound = h.sound AND m.ratio >= 85 GROUP BY ALL
    ), alone AS (SELECT doc_id, i, b.ratio AS ratio FROM best WHERE n = 1), proposed AS (
        SELECT * FROM best p WHERE NOT (n = 2 AND EXISTS (SELECT 1 FROM alone a WHERE a.doc_id = p.doc_id AND a.i IN (p.i, p.i + 1) AND p.b.ratio <= a.ratio))
            AND NOT EXISTS (SELECT 1 FROM taken t WHERE t.doc_id = p.doc_id AND t.start < p."end" AND t."end" > p.start)
            AND NOT (b.term = 'Thintion' AND contains(' ' || run || ' ', ' thention '))
    ), found AS (
        SELECT * FROM taken UNION ALL SELECT doc_id, start, "end", b.term, 'term:phonetic', 'correction', 'ask', floor(b.ratio)::INT FROM proposed
    ) SELECT f.doc_id, f.start, f."end", substr(t.text, f.start + 1, f."end" - f.start) AS original, f.term, f.rule, f.kind, f.band, f.score::INT AS score FROM found f JOIN texts t ON t.doc_id = f.doc_id"""
