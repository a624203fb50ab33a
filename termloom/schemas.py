"""Column layouts and constants of the annotation engine."""

from __future__ import annotations

# Thresholds and limits that define the results.
APPLY_AT, MARK_AT, VARIANT_APPLY_AT = 80, 70, 85
MIN_FUZZY_LENGTH, MAX_LENGTH_GAP = 6, 2
NEAR_SECONDS, NEAR_TOKENS = 90, 200
NGRAMS = 3
PHONETIC_AT, PHONETIC_NGRAMS, MIN_SKELETON = 85, 2, 5
UNIT_CLASS = "unidade"
MIN_FIT_TERMS = 3
CUE_WINDOW_SECONDS = 30.0
DUPLICATE_AT = 90
EXAMPLES_PER_FORM = 3
GOLD_STATUSES = ("certo", "alias", "conferido", "manter", "so_caixa")
GOLD_COLUMNS = ("timestamp", "wrong", "correct", "term", "class", "status")
APPLIED_BANDS, QUESTION_BANDS = ("high", "medium"), ("medium", "ask")

TRANSCRIPTS = "doc_id string, text string"
LINES = "doc_id string, line_no int, ts string, ts_sec int, text string, start int, end int"
ANNOTATIONS = (
    "doc_id string, start int, end int, original string, replacement string, term string, rule string, "
    "kind string, band string, score int, pack_version string"
)
FORMS = (
    "ord int, display string, folded string, run string, term string, origin string, source string, "
    "exact boolean, cased string, fuzzy boolean, owned boolean"
)
CUES = "doc_id string, cue_no int, start double, end double, lines array<string>"

#: A table with at most this many rows may be broadcast; larger ones are joined by shuffling.
BROADCAST_ROWS = 100_000
