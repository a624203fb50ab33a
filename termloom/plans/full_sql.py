"""SQL that states what the full pack finds: guesses, guards, conditions and overlap resolution."""

from __future__ import annotations

from termloom.functions.languages import ENGLISH

_COMMON = "[" + ", ".join(f"'{w}'" for w in sorted(ENGLISH.common)) + "]"

#: Continues the CTEs ``lines``, ``texts`` and ``tokens``; ``annotations`` are all proposals, ``resolved`` those that win.
FULL = rf"""
    forms(form, term, origin, guessed, own) AS (
        VALUES ('orantion', 'orantion', 'term', true, ['orantion']), ('ononst', 'orantion', 'alias', false, ['ononst', 'orantion']),
               ('thatin', 'orantion', 'variant', true, ['orantion', 'thatin']), ('and thatin', 'orantion', 'variant', true, ['and', 'orantion', 'thatin']),
               ('attion', 'attion', 'term', true, ['attion']), ('ertion', 'attion', 'alias', false, ['attion', 'ertion']), ('thtion', 'attion', 'variant', true, ['attion', 'thtion']),
               ('thanedble', 'thanedble', 'term', true, ['thanedble']), ('thanea', 'thanedble', 'alias', false, ['thanea', 'thanedble']), ('hehely', 'hehely', 'term', true, ['hehely'])
    ), parts AS (
        SELECT *, regexp_replace(strip_accents(lower(token)), '[^a-z0-9$ ]+', ' ', 'g') AS part FROM tokens
    ), ahead AS (
        SELECT *, lead(token) OVER w AS t1, lead(token, 2) OVER w AS t2, lead(part) OVER w AS p1, lead(part, 2) OVER w AS p2, lead("end") OVER w AS e1, lead("end", 2) OVER w AS e2, lead(closes) OVER w AS c1
        FROM parts WINDOW w AS (PARTITION BY doc_id ORDER BY i)
    ), spread AS (
        SELECT doc_id, i, 1 AS n, start, "end", token AS raw, trim(part) AS folded FROM ahead
        UNION ALL SELECT doc_id, i, 2, start, e1, token || ' ' || t1, trim(part || ' ' || p1) FROM ahead WHERE e1 IS NOT NULL AND NOT closes
        UNION ALL SELECT doc_id, i, 3, start, e2, token || ' ' || t1 || ' ' || t2, trim(part || ' ' || p1 || ' ' || p2) FROM ahead WHERE e2 IS NOT NULL AND NOT closes AND NOT c1
    ), every AS (
        SELECT *, trim(regexp_replace(folded, ' +', ' ', 'g')) AS run FROM spread
    ), near AS (
        SELECT w.folded, f.form, list_transform(string_split(w.folded, ''), lambda c: list_sum(list_transform(range(1, length(f.form) + 1), lambda p: CASE WHEN f.form[p] = c THEN 1::BIGINT << (p - 1)::BIGINT ELSE 0::BIGINT END))::BIGINT) AS places,
               (1::BIGINT << length(f.form)) - 1 AS whole
        FROM (SELECT DISTINCT folded FROM every WHERE length(folded) >= 6) w JOIN forms f ON f.guessed AND f.form <> w.folded AND length(w.folded) BETWEEN length(f.form) - 2 AND length(f.form) + 2
    ), measured AS (
        SELECT folded, form, 200.0::DOUBLE * (length(form) - bit_count(list_reduce(places, lambda v, u: ((v + (v & u)) | (v - (v & u))) & whole, whole))) / (length(folded) + length(form)) AS score FROM near
    ), reached AS (
        SELECT w.*, 'equal' AS mode, f.term, f.form, f.origin, f.own, 100.0::DOUBLE AS score FROM every w JOIN forms f ON w.folded = f.form
        UNION ALL SELECT w.*, 'guess', f.term, f.form, f.origin, f.own, m.score FROM every w JOIN measured m USING (folded) JOIN forms f ON f.form = m.form WHERE m.score >= 70
        UNION ALL SELECT w.*, 'only', 'inoran', 'inoran', 'term', ['inoran'], 100.0 FROM every w WHERE w.run = 'inoran' AND w.raw = 'inoran'
    ), plurals AS (
        SELECT w.*, f.term, f.form FROM every w JOIN forms f ON f.origin <> 'variant' AND (w.run = f.form || 's' OR w.run = f.form || 'es' OR (f.form LIKE '%y' AND w.run = left(f.form, length(f.form) - 1) || 'ies'))
        WHERE w.run NOT LIKE '%ss' AND w.run <> 'inoran' AND w.run NOT IN (SELECT form FROM forms)
    ), spans AS (
        SELECT doc_id, i, n, term, bool_or(name) AS name FROM (
            SELECT w.doc_id, w.i, w.n, f.term, f.origin <> 'variant' AS name FROM every w JOIN forms f ON w.run = f.form
            UNION ALL SELECT doc_id, i, n, term, true FROM reached WHERE mode = 'only'
            UNION ALL SELECT doc_id, i, n, term, true FROM plurals
        ) GROUP BY doc_id, i, n, term
    ), ranked AS (
        SELECT *, CASE WHEN origin = 'variant' AND folded <> form AND score >= 80 AND score < 85 THEN 79.0 ELSE score END AS rank FROM reached WHERE length(folded) >= 2
    ), best AS (
        SELECT *, folded = form OR mode = 'only' AS matched, row_number() OVER (PARTITION BY doc_id, i, n ORDER BY rank DESC, score DESC, term DESC, form DESC, mode DESC) AS k FROM ranked
    ), held AS (
        SELECT * FROM best b WHERE k = 1 AND NOT (term = 'attion' AND contains(' ' || run || ' ', ' ertion '))
            AND NOT EXISTS (SELECT 1 FROM plurals p WHERE p.doc_id = b.doc_id AND p.i = b.i AND p.n = b.n AND p.n = 1)
    ), fixes AS (
        SELECT *, CASE WHEN matched THEN 'term:variant' ELSE 'term:fuzzy' END AS rule FROM held WHERE NOT (matched AND origin <> 'variant')
    ), guarded AS (
        SELECT * FROM fixes c
        WHERE NOT (rule = 'term:fuzzy' AND len(list_filter(string_split(run, ' '), lambda x: list_contains({_COMMON}, x) AND NOT list_contains(own, x))) > 0)
            AND NOT EXISTS (SELECT 1 FROM spans s WHERE s.doc_id = c.doc_id AND s.i < c.i + c.n AND c.i < s.i + s.n AND (
                (s.name AND s.term = c.term AND s.i <= c.i AND s.i + s.n >= c.i + c.n) OR (c.rule = 'term:fuzzy' AND s.term <> c.term) OR (s.name AND s.term <> c.term AND s.n > c.n)))
    ), proposed AS (
        SELECT doc_id, i, n, start, "end", term, form, CASE origin WHEN 'alias' THEN 'term:alias' ELSE 'term:exact' END AS rule, 'alias' AS kind, 'high' AS band, 100 AS score FROM held WHERE matched AND origin <> 'variant'
        UNION ALL SELECT doc_id, i, n, start, "end", term, form, 'term:alias', 'alias', 'high', 100 FROM plurals WHERE n = 1 AND NOT (term = 'attion' AND contains(' ' || run || ' ', ' ertion '))
        UNION ALL SELECT doc_id, i, n, start, "end", term, form, rule, 'correction',
            CASE WHEN rule <> 'term:fuzzy' THEN 'high' WHEN score >= CASE WHEN origin = 'variant' THEN 85 ELSE 80 END THEN 'medium' ELSE 'low' END, floor(score)::INT FROM guarded
    ), seconds AS (
        SELECT t.doc_id, t.i, l.ts_sec FROM tokens t ASOF JOIN lines l ON t.doc_id = l.doc_id AND t.start >= l.start
    ), apart AS (
        SELECT doc_id, term, list_reduce(list([{{'i': i, 'n': n}}] ORDER BY n DESC, i),
               lambda kept, x: CASE WHEN len(list_filter(kept, lambda k: k.i < x[1].i + x[1].n AND x[1].i < k.i + k.n)) = 0 THEN list_concat(kept, x) ELSE kept END) AS found
        FROM spans WHERE term IN ('hehely', 'attion', 'inoran') GROUP BY doc_id, term
    ), places AS (
        SELECT a.doc_id, a.term, s.ts_sec FROM (SELECT doc_id, term, unnest(found) AS o FROM apart) a JOIN seconds s ON s.doc_id = a.doc_id AND s.i = a.o.i
    ), counted AS (
        SELECT doc_id, count(*) AS uses FROM places WHERE term <> 'inoran' GROUP BY doc_id
    ), weighed AS (
        SELECT p.*, p.term = 'orantion' AND p.form = 'thatin' AS bound, coalesce(c.uses, 0) AS uses,
               EXISTS (SELECT 1 FROM places x WHERE x.doc_id = p.doc_id AND x.term = 'inoran' AND abs(x.ts_sec - s.ts_sec) <= 90) AS close
        FROM proposed p LEFT JOIN counted c ON c.doc_id = p.doc_id LEFT JOIN seconds s ON s.doc_id = p.doc_id AND s.i = p.i
    ), annotations AS (
        SELECT w.doc_id, w.start, w."end", substr(t.text, w.start + 1, w."end" - w.start) AS original, CASE w.kind WHEN 'alias' THEN substr(t.text, w.start + 1, w."end" - w.start) ELSE w.term END AS replacement,
               w.term, w.rule, w.kind, CASE WHEN bound AND band IN ('high', 'medium') AND (uses = 1 OR close) THEN 'ask' ELSE band END AS band, w.score::INT AS score, '2.0.0' AS pack_version
        FROM weighed w JOIN texts t ON t.doc_id = w.doc_id WHERE NOT bound OR uses > 0
    ), picked AS (
        SELECT doc_id, list_reduce(list([{{'s': start, 'e': "end", 'original': original, 'replacement': replacement, 'term': term, 'rule': rule, 'kind': kind, 'band': band, 'score': score}}]
                   ORDER BY band NOT IN ('high', 'medium'), score DESC, start - "end", start, rule, original, replacement, term),
               lambda kept, x: CASE WHEN len(list_filter(kept, lambda k: x[1].s < k.e AND k.s < x[1].e)) = 0 THEN list_concat(kept, x) ELSE kept END) AS found
        FROM annotations GROUP BY doc_id
    ), resolved AS (
        SELECT doc_id, o.s AS start, o.e AS "end", o.original, o.replacement, o.term, o.rule, o.kind, o.band, o.score, '2.0.0' AS pack_version FROM (SELECT doc_id, unnest(found) AS o FROM picked)
    ), asked AS (
        SELECT *, trim(regexp_replace(original, '\s+', ' ', 'g')) AS form FROM resolved WHERE band IN ('medium', 'ask')
    )"""



def down_to(mark: int) -> str:
    """The CTEs of ``FULL`` with guesses down to another mark."""
    return FULL.replace("m.score >= 70", f"m.score >= {mark}")


#: Continues ``down_to(60)``: overlaps are resolved again at each threshold; a demoted guess ranks just below 80.
THRESHOLDS = """
    marks(threshold) AS (VALUES (60), (70), (80)), standing AS (
        SELECT m.threshold, a.* FROM annotations a JOIN marks m ON m.threshold <= CASE WHEN rule <> 'term:fuzzy' THEN 100 WHEN band = 'low' AND score >= 80 THEN 79 ELSE score END
    ), winners AS (
        SELECT doc_id, threshold, list_reduce(list([{'s': start, 'e': "end", 'band': band}] ORDER BY band NOT IN ('high', 'medium'), score DESC, start - "end", start, rule, original, replacement, term),
               lambda kept, x: CASE WHEN len(list_filter(kept, lambda k: x[1].s < k.e AND k.s < x[1].e)) = 0 THEN list_concat(kept, x) ELSE kept END) AS found
        FROM standing GROUP BY doc_id, threshold
    ) SELECT d.doc_id::VARCHAR AS doc_id, m.threshold, coalesce(len(list_filter(w.found, lambda k: k.band = 'low')), 0)::BIGINT AS low_marks
      FROM documents d CROSS JOIN marks m LEFT JOIN winners w ON w.doc_id = d.doc_id::VARCHAR AND w.threshold = m.threshold"""

#: What each query reads from the CTEs above.
SELECTS = {
    "full_annotations": 'SELECT doc_id, start, "end", original, replacement, term, rule, kind, band, score, pack_version FROM annotations',
    "fuzzy_matches": "SELECT original, term, band, score, count(*)::BIGINT AS n FROM annotations WHERE rule = 'term:fuzzy' GROUP BY ALL",
    "resolved_annotations": 'SELECT doc_id, start, "end", original, replacement, term, rule, kind, band, score, pack_version FROM resolved',
    "local_decisions": """, chosen AS (SELECT DISTINCT doc_id, term, original FROM resolved WHERE band = 'ask')
            SELECT r.doc_id, r.start, r."end", r.term, CASE WHEN t THEN 'local' ELSE rule END AS rule, CASE WHEN t THEN 'correction' ELSE kind END AS kind, CASE WHEN t THEN 'high' ELSE band END AS band, r.score
            FROM (SELECT *, band <> 'high' AND (doc_id, term, original) IN (SELECT (doc_id, term, original) FROM chosen) AS t FROM resolved) r""",
    "normalized_annotations": """, chosen AS (SELECT DISTINCT doc_id, term, original FROM resolved WHERE band = 'ask'), decided AS (
            SELECT r.doc_id, r.start, r."end", r.term, CASE WHEN t THEN 'local' ELSE rule END AS rule, CASE WHEN t THEN 'correction' ELSE kind END AS kind, CASE WHEN t THEN 'high' ELSE band END AS band, r.score
            FROM (SELECT *, band <> 'high' AND (doc_id, term, original) IN (SELECT (doc_id, term, original) FROM chosen) AS t FROM resolved) r
        ) SELECT * FROM decided WHERE doc_id IN (SELECT doc_id FROM decided WHERE band = 'high' AND rule <> 'unit' GROUP BY doc_id HAVING count(DISTINCT term) >= 3)""",
    "report_texts": r""", sectioned AS (
            SELECT *, trim(regexp_replace(original, '\s+', ' ', 'g')) AS form, CASE WHEN band = 'high' AND kind = 'correction' AND rule <> 'unit' THEN 1 WHEN band = 'high' AND kind = 'correction' THEN 2 WHEN band = 'high' THEN 3 WHEN band = 'medium' THEN 4 WHEN band = 'ask' THEN 5 END AS part FROM resolved
        ), by_form AS (SELECT doc_id, part, term, form, count(*) AS n, min({'s': start, 'e': "end"}) AS first FROM sectioned WHERE part IS NOT NULL GROUP BY ALL), by_term AS (
            SELECT doc_id, part, term, sum(n)::BIGINT AS total, string_agg(form, ', ' ORDER BY n DESC, first.s, first.e) AS listed FROM by_form GROUP BY ALL
        ), by_part AS (
            SELECT doc_id, part, ['terms', 'unit rules', 'recognized (not changed)', 'applied, please confirm', 'suggested, not applied'][part] || ':' || chr(10)
                   || string_agg('  ' || listed || ' (' || total || CASE WHEN total = 1 THEN ' occurrence' ELSE ' occurrences' END || ') -> ' || term, chr(10) ORDER BY total DESC, term) AS text
            FROM by_term GROUP BY doc_id, part
            UNION ALL SELECT doc_id, 6, count(*) || ' low-confidence marks, not applied' FROM resolved WHERE band = 'low' GROUP BY doc_id
        ), whole AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY part) AS text FROM by_part GROUP BY doc_id)
        SELECT t.doc_id, coalesce(w.text, 'no annotations.') AS text FROM texts t LEFT JOIN whole w USING (doc_id)""",
    "pending_texts": r""", by_form AS (SELECT doc_id, term, form, count(*) AS n FROM asked GROUP BY ALL), totals AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, term)::BIGINT AS total FROM by_form), spots AS (
            SELECT *, row_number() OVER (PARTITION BY doc_id, term, form ORDER BY start, "end") AS k FROM asked
        ), shown AS (
            SELECT s.doc_id, s.term, s.form, s.k, chr(10) || '    ' || string_agg(l.ts, '/' ORDER BY l.line_no) || '  ' || trim(regexp_replace(string_agg(l.text, ' ' ORDER BY l.line_no), '\s+', ' ', 'g')) AS line
            FROM spots s JOIN lines l ON l.doc_id = s.doc_id AND l.start < s."end" AND s.start < l."end" WHERE s.k <= 3 GROUP BY ALL
        ), listed AS (SELECT doc_id, term, form, string_agg(line, '' ORDER BY k) AS shown FROM shown GROUP BY ALL), blocks AS (
            SELECT t.*, chr(10) || '  ' || form || '  (' || n || CASE WHEN n = 1 THEN ' occurrence' ELSE ' occurrences' END || ')  ' || CASE length(form) % 3 WHEN 0 THEN '[never asked]' ELSE '[skipped]' END || shown AS block
            FROM totals t JOIN listed USING (doc_id, term, form) WHERE length(form) % 3 <> 2
        ), terms AS (SELECT doc_id, term, total, count(*) AS forms, term || '  (' || total || CASE WHEN total = 1 THEN ' occurrence' ELSE ' occurrences' END || ')' || string_agg(block, '' ORDER BY n DESC, form) AS text FROM blocks GROUP BY doc_id, term, total)
        SELECT doc_id, sum(forms)::BIGINT AS n, string_agg(text, chr(10) || chr(10) ORDER BY total DESC, term) || chr(10) AS text FROM terms GROUP BY doc_id""",
    "run_totals": r""", changes AS (SELECT doc_id, original || ' → ' || replacement AS change, min({'s': start, 'e': "end"}) AS first FROM resolved WHERE band = 'high' AND kind = 'correction' GROUP BY ALL),
            in_order AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first.s, first.e) AS k FROM changes), few AS (SELECT doc_id, string_agg(change, ', ' ORDER BY k) AS pairs FROM in_order WHERE k <= 2 GROUP BY doc_id),
            formed AS (SELECT *, trim(regexp_replace(original, '\s+', ' ', 'g')) AS form FROM resolved)
            SELECT doc_id, sum((kind = 'correction' AND band = 'high')::INT)::BIGINT AS corrected, sum((kind = 'alias' AND band = 'high')::INT)::BIGINT AS recognized,
                   count(DISTINCT CASE WHEN kind = 'correction' AND band = 'medium' THEN {'t': term, 'f': form} END)::BIGINT AS to_confirm, count(DISTINCT CASE WHEN band = 'ask' THEN {'t': term, 'f': form} END)::BIGINT AS suggested, coalesce(any_value(pairs), '') AS pairs
            FROM formed LEFT JOIN few USING (doc_id) GROUP BY doc_id""",
    "pending_forms": """, grouped AS (SELECT doc_id, term, form, count(*)::BIGINT AS n FROM asked GROUP BY ALL), totals AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, term)::BIGINT AS term_total FROM grouped)
            SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY term_total DESC, term)::INT AS term_rank, row_number() OVER (PARTITION BY doc_id, term ORDER BY n DESC, form)::INT AS form_rank, '[never asked]' AS tag FROM totals""",
    "low_marks": "SELECT doc_id, sum((band = 'low')::INT)::BIGINT AS low_marks FROM resolved GROUP BY doc_id",
    "term_occurrences": """, chosen AS (SELECT doc_id, term, list_reduce(list([{'i': i, 'n': n}] ORDER BY n DESC, i),
               lambda kept, x: CASE WHEN len(list_filter(kept, lambda k: k.i < x[1].i + x[1].n AND x[1].i < k.i + k.n)) = 0 THEN list_concat(kept, x) ELSE kept END) AS found FROM spans GROUP BY doc_id, term)
            SELECT doc_id, term, o.i AS i, o.n AS n FROM (SELECT doc_id, term, unnest(found) AS o FROM chosen)""",
    "review_context": r""", stops AS (SELECT doc_id, term, form, count(*)::BIGINT AS n, min({'s': start, 'e': "end"}) AS first FROM asked GROUP BY ALL), numbered AS (
            SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY first.s, first.e, term, form)::INT AS k, count(*) OVER (PARTITION BY doc_id)::INT AS n_stops FROM stops
        ), around AS (SELECT *, lag(ts) OVER w AS before_ts, lag(text) OVER w AS before, lead(ts) OVER w AS after_ts, lead(text) OVER w AS after FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)), spots AS (
            SELECT s.doc_id, s.term, s.form, s.k, s.n_stops, s.n, s.first, arg_min({'ts': l.ts, 'low': l.start, 'before_ts': l.before_ts, 'before': l.before}, l.line_no) AS head, arg_max({'high': l."end", 'after_ts': l.after_ts, 'after': l.after}, l.line_no) AS tail
            FROM numbered s JOIN around l ON l.doc_id = s.doc_id AND l.start < s.first.e AND s.first.s < l."end" GROUP BY ALL
        ), stamped AS (SELECT a.doc_id, a.term, a.form, l.ts, min(a.start) AS spot FROM asked a ASOF JOIN lines l ON a.doc_id = l.doc_id AND a.start >= l.start GROUP BY ALL), listed AS (
            SELECT doc_id, term, form, array_to_string(list(ts ORDER BY spot)[2:], ', ') AS elsewhere FROM stamped GROUP BY ALL
        ), linked AS (SELECT page_id::VARCHAR AS doc_id, url FROM pages)
        SELECT s.doc_id, s.term, s.form, s.k, s.n_stops, s.n, head.before_ts AS before_ts, head.before AS before, head.ts AS ts, tail.after_ts AS after_ts, tail.after AS after, elsewhere,
            trim(regexp_replace(substr(t.text, head.low + 1, first.s - head.low) || '«' || substr(t.text, first.s + 1, first.e - first.s) || '»' || substr(t.text, first.e + 1, tail.high - first.e), '\s+', ' ', 'g')) AS shown,
            coalesce(u.url || ' at ' || head.ts, '') AS link
        FROM spots s JOIN listed USING (doc_id, term, form) JOIN texts t ON t.doc_id = s.doc_id LEFT JOIN linked u ON u.doc_id = s.doc_id""",
    "review_answers": "{told} SELECT * FROM told",
    "reviewed_annotations": """{told} SELECT r.doc_id, r.start, r."end", r.original, CASE WHEN takes THEN CASE WHEN answer = 'alias' THEN r.original ELSE r.term END ELSE r.replacement END AS replacement, r.term,
            CASE WHEN takes THEN CASE answer WHEN 'alias' THEN 'term:alias' WHEN 'local' THEN 'local' ELSE 'term:variant' END ELSE rule END AS rule, CASE WHEN takes THEN CASE answer WHEN 'alias' THEN 'alias' ELSE 'correction' END ELSE kind END AS kind,
            CASE WHEN takes THEN 'high' ELSE band END AS band, r.score
            FROM (SELECT r.*, t.answer, band IN ('medium', 'ask') AND coalesce(t.answer IN ('yes', 'local', 'alias', 'context'), false) AS takes, band IN ('medium', 'ask') AND (coalesce(t.answer = 'no', false) OR t.taken_by IS NOT NULL) AS gone
                  FROM resolved r LEFT JOIN told t ON t.doc_id = r.doc_id AND t.term = r.term AND t.form = trim(regexp_replace(r.original, '\\s+', ' ', 'g'))) r WHERE NOT gone""",
    "review_stops": """, stops AS (SELECT doc_id, term, form, count(*)::BIGINT AS n, min({'s': start, 'e': "end"}) AS first FROM asked GROUP BY ALL)
            SELECT doc_id, term, form, n, first.s AS start, row_number() OVER (PARTITION BY doc_id ORDER BY first.s, first.e, term)::INT AS k, count(*) OVER (PARTITION BY doc_id)::BIGINT AS n_stops FROM stops""",
}

_TOLD = """, numbered AS (
        SELECT doc_id, term, form, dense_rank() OVER (PARTITION BY doc_id ORDER BY first.s, first.e, term, form)::INT AS k FROM (SELECT doc_id, term, form, min({'s': start, 'e': "end"}) AS first FROM asked GROUP BY ALL)
    ), replied AS (SELECT *, ['yes', 'local', 'alias', 'no', 'later', 'context'][(k + length(form)) % 6 + 1] AS said FROM numbered), first_taken AS (
        SELECT doc_id, form, min(k) AS k, arg_min(term, k) AS term FROM replied WHERE said NOT IN ('no', 'later') GROUP BY ALL
    ), told AS (
        SELECT r.doc_id, r.term, r.form, r.k, CASE WHEN coalesce(r.k > t.k, false) THEN NULL ELSE said END AS answer, CASE WHEN said = 'context' AND NOT coalesce(r.k > t.k, false) THEN r.term END AS context, CASE WHEN r.k > t.k THEN t.term END AS taken_by
        FROM replied r LEFT JOIN first_taken t ON t.doc_id = r.doc_id AND t.form = r.form
    )"""
SELECTS = {name: text.replace("{told}", _TOLD) for name, text in SELECTS.items()}

#: Continues ``FULL`` with a CTE ``gold`` of ``doc_id, row_no, ts, wrong, correct, term, status``.
EVALUATE = r"""
    keyed AS (
        SELECT *, trim(regexp_replace(regexp_replace(strip_accents(lower(original)), '[^a-z0-9$ ]+', ' ', 'g'), ' +', ' ', 'g')) AS key FROM resolved WHERE band IN ('high', 'medium')
    ), placed AS (
        SELECT k.doc_id, k.start, k."end", {'s': k.start, 'e': k."end"} AS a, k.key, k.term, k.kind, k.original, l.line_no, l.ts FROM keyed k JOIN lines l ON k.doc_id = l.doc_id AND l.start < k."end" AND k.start < l."end"
    ), asked_rows AS (
        SELECT *, trim(regexp_replace(regexp_replace(strip_accents(lower(wrong)), '[^a-z0-9$ ]+', ' ', 'g'), ' +', ' ', 'g')) AS wrong_key,
               trim(regexp_replace(regexp_replace(strip_accents(lower(correct)), '[^a-z0-9$ ]+', ' ', 'g'), ' +', ' ', 'g')) AS correct_key FROM gold
    ), scope AS (
        SELECT * FROM asked_rows WHERE term <> '' AND (status = 'alias' OR wrong_key <> correct_key)
    ), answers AS (
        SELECT g.doc_id, g.row_no, g.status, g.term, min(CASE WHEN p.kind = 'correction' THEN p.a END) AS any_fix, min(CASE WHEN p.kind = 'correction' AND p.term = g.term THEN p.a END) AS fix,
               min(CASE WHEN p.kind = 'alias' AND p.term = g.term THEN p.a END) AS name
        FROM scope g LEFT JOIN placed p ON p.doc_id = g.doc_id AND p.ts = g.ts AND (contains(p.key, g.wrong_key) OR contains(g.wrong_key, p.key)) GROUP BY g.doc_id, g.row_no, g.status, g.term
    ), scored AS (
        SELECT doc_id, term, CASE WHEN status = 'alias' THEN any_fix END AS bad, CASE WHEN status <> 'alias' THEN fix WHEN any_fix IS NULL THEN name END AS good, status = 'alias' AS named FROM answers
    ), credit AS (
        SELECT p.* FROM placed p WHERE EXISTS (SELECT 1 FROM scored s WHERE s.doc_id = p.doc_id AND s.good = p.a)
    ), idle AS (
        SELECT p.* FROM placed p WHERE p.kind = 'correction' AND NOT EXISTS (SELECT 1 FROM scored s WHERE s.doc_id = p.doc_id AND (s.good = p.a OR s.bad = p.a))
    ), nested AS (
        SELECT DISTINCT i.doc_id, i.a FROM idle i JOIN credit c ON c.doc_id = i.doc_id AND c.line_no = i.line_no AND (contains(i.key, c.key) OR contains(c.key, i.key))
    ), false_ones AS (
        SELECT DISTINCT doc_id, a FROM idle EXCEPT SELECT doc_id, a FROM nested UNION SELECT DISTINCT doc_id, bad FROM scored WHERE bad IS NOT NULL
    )"""

EVALUATIONS = {
    "evaluate_counts": """, by_row AS (
            SELECT doc_id, count(*) AS in_scope, sum((good IS NOT NULL)::INT) AS hits, sum((good IS NULL)::INT) AS misses, sum((named AND good IS NOT NULL)::INT) AS aliases_recognized, sum((bad IS NOT NULL)::INT) AS aliases_substituted
            FROM scored GROUP BY doc_id
        ), by_false AS (SELECT doc_id, count(*) AS false_positives FROM false_ones GROUP BY doc_id)
        SELECT doc_id, coalesce(in_scope, 0)::BIGINT AS in_scope, coalesce(hits, 0)::BIGINT AS hits, coalesce(misses, 0)::BIGINT AS misses, coalesce(aliases_recognized, 0)::BIGINT AS aliases_recognized,
            coalesce(aliases_substituted, 0)::BIGINT AS aliases_substituted, coalesce(false_positives, 0)::BIGINT AS false_positives FROM by_row FULL JOIN by_false USING (doc_id)""",
    "gold_terms": " SELECT term, sum((good IS NOT NULL)::INT)::BIGINT AS hits, count(*)::BIGINT AS total FROM scored GROUP BY term",
    "false_forms": """, wrongly AS (SELECT f.doc_id, f.a, min(p.original) AS original, min(p.term) AS term FROM false_ones f JOIN placed p ON p.doc_id = f.doc_id AND p.a = f.a WHERE p.kind = 'correction' GROUP BY f.doc_id, f.a)
        SELECT original, term, count(*)::BIGINT AS n FROM wrongly GROUP BY ALL""",
    "false_marks": """ SELECT f.doc_id, f.a.s AS start, arg_min(p.ts, p.line_no) AS ts, min(p.original) AS original, min(p.term) AS term FROM false_ones f JOIN placed p ON p.doc_id = f.doc_id AND p.a = f.a
        WHERE p.kind = 'correction' GROUP BY f.doc_id, f.a""",
}
