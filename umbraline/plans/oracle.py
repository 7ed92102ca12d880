"""The SQL beside the queries, for any engine that reads the same tables."""

from __future__ import annotations

from umbraline.functions import names as N
from umbraline.functions import text as X
from umbraline.functions.validators import EIN_RESERVED
from umbraline.operators import labels as L
from umbraline.operators import rules as U
from umbraline.operators.rule_tables import FIGURE_LABELS, FORM_WORDS, LABELS as LABEL_RULES, OTHER_THRESHOLDS, RULES, THRESHOLDS, Rule


def q(text: str) -> str:
    """``text`` as an SQL string."""
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return ", ".join(q(v) for v in values)


# Signs that stand for plain ones, one for one.
LOOKALIKE_FROM = " ‘’“”‐‑‒–—−   "
LOOKALIKE_TO = " ''\"\"------   "

LINES = "l AS (SELECT DISTINCT fixture, page_no, block_no, line_no, text, x0, y0, x1, y1, font, size, color FROM fixture_lines)"
CANDS = (
    "c AS (SELECT DISTINCT cand_id, fixture, page_no, block_no, line_no, span_start, span_end, text, pii_type, confidence, source, evidence, group_id, "
    "needs_review, review_reason, adjudication, label_confirmed FROM candidates)"
)
_BLANKS = "[ \\t\\r\\n\\f\\v]+"
COLLAPSED = f"trim(regexp_replace(text, '{_BLANKS}', ' ', 'g'), ' ')"
NORM = f"trim({COLLAPSED}, ' .,;:')"
NORM_TEXT = f"lower({NORM})"
KEY = "fixture, page_no, block_no, line_no"


def fold(x: str) -> str:
    marked, plain = X.accent_table()
    t = f"translate(lower({x}), {q(marked)}, {q(plain)})"
    for letter, two in X.TWO_LETTERS.items():
        t = f"replace({t}, {q(letter)}, {q(two)})"
    t = f"regexp_replace({t}, '[\\x{{0300}}-\\x{{036F}}]', '', 'g')"
    t = f"translate({t}, {q(X.HYPHENS)}, {q(' ' * len(X.HYPHENS))})"
    t = f"translate({t}, {q(X.APOSTROPHES)}, '')"
    return f"trim(regexp_replace({t}, '{_BLANKS}', ' ', 'g'), ' ')"


SCAN_LINES = r"""
WITH s AS (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\f\v\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS p FROM documents),
r AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, p[i] AS text FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM s))
SELECT doc_id, line_no, text, CAST(0 AS DOUBLE) AS x0, line_no * CAST(12 AS DOUBLE) AS y0, length(text) * CAST(5 AS DOUBLE) AS x1, (line_no + 1) * CAST(12 AS DOUBLE) AS y1
FROM r WHERE regexp_matches(text, '[^ \t\v\f\r\n\x{a0}]')"""

PAGE_QUALITY = f"""WITH {LINES}, p AS (SELECT fixture, page_no, sum(length(regexp_replace(text, '{_BLANKS}', '', 'g'))) AS chars,
sum(length(regexp_replace(text, '[^\\p{{L}}]', '', 'g'))) AS letters, sum(length(regexp_replace(text, '[^\\x{{FFFD}}\\x00-\\x08]', '', 'g'))) AS bad FROM l GROUP BY ALL)
SELECT fixture, page_no, CAST(chars AS BIGINT) AS chars, CAST(letters AS BIGINT) AS letters,
CASE WHEN chars < 24 THEN 'empty' WHEN bad * 20 > chars OR letters * 100 < chars * 35 THEN 'unreadable' ELSE 'ok' END AS state FROM p"""

# Rules

CTX = f"""{LINES}, cp AS (SELECT a.fixture, a.page_no, a.block_no, a.line_no, o.text AS ot, o.y1 AS oy1, o.block_no AS ob, o.line_no AS ol, a.y0 - o.y1 < 1.8 * greatest(a.y1 - a.y0, 1.0) AS near,
NOT (o.x1 < a.x0 - 2 OR a.x1 < o.x0 - 2) AS col FROM l a JOIN l o ON a.fixture = o.fixture AND a.page_no = o.page_no AND o.y1 <= a.y0 + 1),
cn AS (SELECT {KEY}, ot AS nt FROM cp WHERE near QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY oy1 DESC, ob, ol) = 1),
cc AS (SELECT {KEY}, string_agg(ot, ' ' ORDER BY r) AS ct FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY oy1 DESC, ob, ol) AS r FROM cp WHERE col) WHERE r <= 8 GROUP BY ALL),
x AS (SELECT l.*, lower(concat_ws(' ', text, nt, ct)) AS context FROM l LEFT JOIN cn USING ({KEY}) LEFT JOIN cc USING ({KEY}))"""
CONTEXT = f"WITH {CTX} SELECT {KEY}, md5(coalesce(context, '')) AS context_md5 FROM x"
PLAIN_RULES = "email iban swift_bic ipv4 mac uuid city_state_zip street_address po_box dob drivers_license mrn claim_number case_number employee_id customer_id".split()
DIGIT_RULES = {  # name: (core, characters that may not stand before, and behind)
    "ssn_dashed": (r"\d{3}-\d{2}-\d{4}", r"\d-", r"\d-"),
    "ssn_spaced": (r"\d{3}\s\d{2}\s\d{4}", r"\d", r"\d"),
    "ssn_plain_unlabelled": (r"\d{9}", r"\d\-", r"\d\-"),
    "ssn_plain": (r"\d{9}", r"\d\-", r"\d\-"),
    "itin": (r"9\d{2}-[7-9]\d-\d{4}", r"\d-", r"\d-"),
    "ein": (r"\d{2}-\d{7}", r"\d-", r"\d-"),
    "ein_spaced": (r"\d{2}\s\d{7}", r"\d", r"\d"),
    "ip_pin": (r"\d{6}", r"\d", r"\d"),
    "routing_aba": (r"\d{9}", r"\d", r"\d"),
}


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '', 'g')"


def check_sql(kind: str, v: str) -> str:
    """A validator over the value ``v``."""
    d = _digits(v)
    at = lambda i: f"CAST(substr({d}, {i}, 1) AS INTEGER)"
    if kind == "ssn":
        return f"(length({d}) = 9 AND substr({d}, 1, 3) NOT IN ('000', '666') AND substr({d}, 1, 1) <> '9' AND substr({d}, 4, 2) <> '00' AND substr({d}, 6, 4) <> '0000')"
    if kind == "ein":
        return f"(length({d}) = 9 AND substr({d}, 1, 2) NOT IN ({listed(EIN_RESERVED)}))"
    if kind == "aba":
        total = f"(3 * ({at(1)} + {at(4)} + {at(7)}) + 7 * ({at(2)} + {at(5)} + {at(8)}) + {at(3)} + {at(6)} + {at(9)})"
        return f"(CASE WHEN length({d}) = 9 THEN {total} % 10 = 0 ELSE false END)"
    digit = f"CAST(substr(reverse({d}), i, 1) AS INTEGER)"
    doubled = f"CASE WHEN i % 2 = 1 THEN {digit} WHEN {digit} * 2 > 9 THEN {digit} * 2 - 9 ELSE {digit} * 2 END"
    return f"(length({d}) BETWEEN 13 AND 19 AND coalesce(list_sum(list_transform(range(1, length({d}) + 1), lambda i: {doubled})), 1) % 10 = 0)"


VALIDATORS = f"WITH {CANDS} SELECT cand_id, {', '.join(f'coalesce({check_sql(k, chr(116) + chr(101) + chr(120) + chr(116))}, false) AS valid_{k}' for k in ('ssn', 'ein', 'luhn', 'aba'))} FROM c WHERE text IS NOT NULL"


def _judge(rule: Rule) -> str:
    """The rows of one rule from ``m`` (line key, context, span_start, value)."""
    cue = "(" + " OR ".join(f"contains(context, {q(c)})" for c in rule.cues) + ")" if rule.cues else "false"
    ok = f"coalesce({check_sql(rule.validator, 'value')}, false)" if rule.validator else "true"
    sure = f"CASE WHEN {cue} THEN least(0.99, {rule.confidence + 0.08!r}) ELSE {rule.confidence!r} END"
    review = f"NOT {ok}" + (f" OR NOT {cue}" if rule.review_unless_context else "")
    keep = f"({ok} OR {cue})" + (f" AND {cue}" if rule.context_required else "")
    return (
        f"SELECT {KEY}, {q(rule.name)} AS rule, {q(rule.pii_type)} AS pii_type, CAST(span_start AS INTEGER) AS span_start, CAST(span_start + length(value) AS INTEGER) AS span_end, value, "
        f"CAST(round(CASE WHEN {ok} THEN {sure} ELSE least({sure}, 0.6) END, 4) AS DOUBLE) AS confidence, ({review}) AS needs_review FROM m WHERE {keep}"
    )


def _found(source: str, pattern: str) -> str:
    """``m`` for a pattern without look-around: matches placed by the gaps between them, in ``plain``."""
    return (
        f"SELECT * REPLACE (substr(text, CAST(span_start AS BIGINT) + 1, length(value)) AS value) FROM (SELECT *, list_sum(list_transform(g[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda v: length(v))), 0) AS span_start, f[i] AS value FROM "
        f"(SELECT *, unnest(range(1, len(f) + 1)) AS i FROM (SELECT *, regexp_extract_all(plain, {q(pattern)}) AS f, string_split_regex(plain, {q(pattern)}) AS g FROM {source} "
        f"WHERE regexp_matches(plain, {q(pattern)}))))"
    )


def rules_sql(rules: list[Rule]) -> str:
    # A letter beyond ASCII is one of a word, which \\b does not know here: it becomes one that is.
    letters = "array_to_string(list_transform(string_split(text, ''), lambda v: CASE WHEN ord(v) > 127 AND regexp_matches(v, '[\\p{L}\\p{M}\\p{N}]') THEN '_' ELSE v END), '')"
    parts = []
    for r in rules:
        pattern = r.pattern if r.case_sensitive else "(?i)" + r.pattern
        # Where "_" may be part of a match the text is read as it is.
        source = "(SELECT * REPLACE (text AS plain) FROM xp)" if "._" in pattern else "xp"
        parts.append(f"(WITH m AS ({_found(source, pattern)}) {_judge(r)})")
    return f"WITH {CTX}, xp AS (SELECT *, {letters} AS plain FROM x) " + " UNION ALL ".join(parts)


def digit_rules_sql() -> str:
    parts = []
    for r in RULES:
        if r.name in DIGIT_RULES:
            core, before, behind = DIGIT_RULES[r.name]
            m = (
                f"SELECT *, i - 1 AS span_start, regexp_extract(substr(text, i), {q('^(' + core + ')')}, 1) AS value FROM (SELECT *, unnest(range(1, length(text) + 1)) AS i FROM x "
                f"WHERE regexp_matches(text, {q(core)})) WHERE regexp_matches(substr(text, i), {q('^' + core + '(?:$|[^' + behind + '])')}) "
                f"AND (i = 1 OR NOT regexp_matches(substr(text, i - 1, 1), {q('[' + before + ']')}))"
            )
            parts.append(f"(WITH m AS ({m}) {_judge(r)})")
    return f"WITH {CTX} " + " UNION ALL ".join(parts)


MONEY = f"""WITH {LINES}, t AS (SELECT *, list_sort(list_transform(list_concat(regexp_extract_all(text, {q(U.MONEY)}), regexp_extract_all(text, {q(U.PERCENT)})),
lambda v: regexp_replace(v, '\\s', '', 'g'))) AS t FROM l) SELECT {KEY}, array_to_string(t, ' ') AS tokens FROM t WHERE len(t) > 0"""

# Labels

_RULE_ROWS = ", ".join(f"({n}, {q('(?i)' + chr(92) + 'b(?:' + p + ')' + chr(92) + 'b')}, {q(','.join(e))})" for n, (p, e) in enumerate(LABEL_RULES))
_FIGURE = "greatest(" + ", ".join(f"length(regexp_extract(label, {q('(?i)' + chr(92) + 'b(?:' + p + ')' + chr(92) + 'b')}))" for p in FIGURE_LABELS) + ")"
_PIECE, _LATER = r"\S+(?: \S+)*", r"\S(?: {2,}|\t+)[A-Za-z][A-Za-z '&/().,\-]{1,40}?:"
_LEN = lambda x: f"CAST(coalesce(list_sum(list_transform({x}, lambda v: length(v))), 0) AS BIGINT)"
LABELS_CTE = f"""{LINES}, h1 AS (SELECT *, regexp_extract(text, '^([^:]{{2,60}}):', 1) AS head FROM l),
h2 AS (SELECT *, regexp_matches(head, {q(L.VALUE)}) AS bears, substr(text, length(head) + 1) AS rest FROM h1),
p0 AS (SELECT {KEY}, head, regexp_extract_all(head, {q(_PIECE)}) AS f, string_split_regex(head, {q(_PIECE)}) AS g FROM h2 WHERE head <> '' AND bears),
p1 AS (SELECT {KEY}, len(f) AS k, unnest(range(1, len(f) + 1)) AS i, f, g FROM p0),
p2 AS (SELECT {KEY}, k, i, f[i] AS v, {_LEN('f[1:i - 1]')} + {_LEN('g[1:i]')} AS a, rtrim(regexp_extract(f[i], {q(r"^((?:[^\s\d@$]+(?: |$))*)")}, 1), ' ') AS raw FROM p1),
t0 AS (SELECT {KEY}, head, rest, regexp_extract_all(rest, {q(_LATER)}) AS f, string_split_regex(rest, {q(_LATER)}) AS g FROM h2 WHERE head <> '' AND NOT bears),
t1 AS (SELECT {KEY}, length(head) AS h, unnest(range(1, len(f) + 1)) AS i, f, g FROM t0),
t2 AS (SELECT {KEY}, h + {_LEN('f[1:i]')} + {_LEN('g[1:i]')} AS b, regexp_extract(f[i], '^.[ \\t]+(.*):$', 1) AS raw FROM t1),
xs AS (SELECT {KEY}, head AS raw, 0 AS a, length(head) + 1 AS b, true AS colon FROM h2 WHERE head <> '' AND NOT bears
UNION ALL SELECT {KEY}, raw, b - 1 - length(raw), b, true FROM t2
UNION ALL SELECT {KEY}, raw, a, a + length(raw) + CASE WHEN i = k AND raw = v THEN 1 ELSE 0 END, true FROM p2
UNION ALL SELECT {KEY}, text, 0, length(text), false FROM h2 WHERE head = '' AND NOT regexp_matches(text, {q(L.VALUE)})),
cl AS (SELECT *, trim(regexp_replace(regexp_replace(raw, '[.\\x{{2026}}_\\-]{{2,}}\\s*$', ''), '^[\\s\\-\\x{{2010}}-\\x{{2015}}\\x{{2022}}\\x{{25cf}}\\x{{25aa}}*]+', ''), ' ') AS label FROM xs),
rr(n, p, e) AS (VALUES {_RULE_ROWS}),
dl AS (SELECT DISTINCT label FROM cl WHERE label <> ''),
fit AS (SELECT label, n, e, regexp_extract(label, p) AS f FROM dl, rr),
ft AS (SELECT *, len(list_filter(string_split_regex(label, '\\s+'), lambda w: w <> '')) > 4 AND len(list_filter(string_split_regex(regexp_replace(left(label, strpos(label, f) - 1),
'(?i)^\\s*if\\b[^,.;:]{{0,40}},\\s*', ''), '\\s+'), lambda w: w <> '')) > 2 AS buried FROM fit WHERE length(trim(f, ' ')) >= 3),
best AS (SELECT label, arg_max(e, {{'e': strpos(label, f) + length(f), 'l': length(f), 'o': -n}}) AS expects FROM ft WHERE NOT buried GROUP BY label),
dk AS (SELECT dl.label, {_FIGURE.replace('label', 'dl.label')} >= {L.DOMINANCE} * length(dl.label) AS figure, best.expects AS found, regexp_matches(dl.label, '^[A-Za-z][A-Za-z0-9 ''&/().,\\-]{{1,44}}$') AS words,
regexp_matches(dl.label, '(?i)^(?:\\p{{L}}[\\p{{L}}\\p{{N}}_.''\\x{{2019}}\\-]*\\s+){{1,3}}(?:city|town)\\.?$') AND NOT list_has_any(list_transform(string_split_regex(lower(dl.label), '\\s+'), lambda w: trim(w, '.,''’')),
[{listed(w for w in [*FORM_WORDS, *L.PLACE_MODIFIERS] if w not in ("city", "town"))}]) AS place FROM dl LEFT JOIN best USING (label) WHERE length(dl.label) <= 110),
kk AS (SELECT cl.*, figure, found FROM cl JOIN dk USING (label) WHERE (figure OR (found IS NOT NULL AND NOT place) OR (found IS NULL AND words)) AND (colon OR figure OR found IS NOT NULL)),
lab AS (SELECT l.*, label, kk.a AS label_start, kk.b AS label_end, CASE WHEN figure OR found IS NULL THEN '' ELSE found END AS expects, figure AS non_pii, NOT figure AND found IS NULL AS unknown,
trim(substr(text, kk.b + 1, coalesce(lead(kk.a) OVER w, length(text)) - kk.b), ' ') AS value, row_number() OVER w AS n_label FROM kk JOIN l USING ({KEY}) WINDOW w AS (PARTITION BY {KEY} ORDER BY kk.a)),
last AS (SELECT * FROM lab QUALIFY n_label = max(n_label) OVER (PARTITION BY {KEY}))"""
LABELS = f"WITH {LABELS_CTE} SELECT {KEY}, label, CAST(label_start AS INTEGER) AS label_start, CAST(label_end AS INTEGER) AS label_end, expects, non_pii, unknown FROM lab"

RIGHT = f"""WITH {LABELS_CTE}, j AS (SELECT a.fixture, a.page_no, a.block_no, a.line_no, a.label, b.x0, b.block_no AS value_block, b.line_no AS value_line, b.text AS value
FROM last a JOIN l b ON a.fixture = b.fixture AND a.page_no = b.page_no WHERE a.value = '' AND NOT a.non_pii AND b.x0 >= a.x1 - 0.5 AND b.x0 - a.x1 <= {L.RIGHT_GAP}
AND (b.y0 + b.y1) / 2 BETWEEN a.y0 AND a.y1 AND length(regexp_replace(b.text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 2)
SELECT {KEY}, label, value_block, value_line, value FROM j QUALIFY row_number() OVER (PARTITION BY {KEY}, label ORDER BY x0, value_block, value_line, value) = 1"""

STACKED = f"""WITH {LABELS_CTE}, p AS (SELECT l.*, last.label, last.non_pii OR last.value <> '' AS non_pii FROM l LEFT JOIN last USING (fixture, page_no, block_no, line_no)),
r AS (SELECT *, sum(CASE WHEN label IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY fixture, page_no ORDER BY y0, x0, block_no, line_no) AS run FROM p),
h AS (SELECT *, first_value(block_no) OVER w AS label_block, first_value(line_no) OVER w AS label_line, first_value(label) OVER w AS head, first_value(x0) OVER w AS head_x,
first_value(non_pii) OVER w AS skip, lag(y1) OVER w AS above, row_number() OVER w - 1 AS position FROM r WHERE run > 0 WINDOW w AS (PARTITION BY fixture, page_no, run ORDER BY y0, x0, block_no, line_no)),
s AS (SELECT *, sum(CASE WHEN position > 0 AND coalesce(abs(x0 - head_x) > {L.LEFT_DRIFT} OR y0 - above > {L.BELOW_GAP} * (y1 - y0), true) THEN 1 ELSE 0 END)
OVER (PARTITION BY fixture, page_no, run ORDER BY y0, x0, block_no, line_no) AS stopped FROM h)
SELECT fixture, page_no, label_block, label_line, head AS label, CAST(position AS INTEGER) AS position, block_no, line_no, text AS value
FROM s WHERE NOT skip AND position BETWEEN 1 AND {L.STACKED} AND stopped = 0"""

CLIPPED = f"""WITH {CANDS}, {LABELS_CTE}, m AS (SELECT cand_id, max(label_end) AS e FROM c JOIN lab USING (fixture, page_no, block_no, line_no) WHERE span_start < label_end AND label_start < span_end GROUP BY ALL),
j AS (SELECT cand_id, span_start, span_end, text, greatest(span_start, coalesce(e, 0)) AS s FROM c LEFT JOIN m USING (cand_id) WHERE text IS NOT NULL),
p AS (SELECT *, substr(text, s - span_start + 1) AS part FROM j)
SELECT cand_id, CAST(s + length(part) - length(ltrim(part, ' ')) AS INTEGER) AS span_start, span_end, trim(part, ' ') AS value FROM p WHERE s < span_end AND trim(part, ' ') <> ''"""

RETYPED = f"""WITH {CANDS}, {LABELS_CTE} SELECT c.cand_id, c.pii_type, lab.expects AS label_type FROM c JOIN lab USING (fixture, page_no, block_no, line_no)
WHERE c.text IS NOT NULL AND c.pii_type IS NOT NULL AND c.source <> 'manual' AND lab.expects <> '' AND NOT contains(lab.expects, ',') AND c.pii_type <> lab.expects
AND (least(c.span_end, lab.label_end + length(substr(lab.text, lab.label_end + 1)) - length(ltrim(substr(lab.text, lab.label_end + 1), ' ')) + length(lab.value)) - greatest(c.span_start, lab.label_end)) * 2 >= c.span_end - c.span_start"""

# Aggregations

_CASE = lambda k: "CASE " + " ".join(f"WHEN pii_type = {q(t)} THEN {v[k]}" for t, v in THRESHOLDS.items()) + f" ELSE {OTHER_THRESHOLDS[k]} END"
ADJUDICATED = f"""WITH {CANDS}, w AS (SELECT cand_id, pii_type, coalesce(confidence, 0.0) AS own, list_transform(evidence, lambda e: e.weight) AS w FROM c),
s AS (SELECT *, coalesce(list_product(list_transform(list_filter(w, lambda v: v > 0), lambda v: 1 - least(v, 0.99))), 1.0) AS p, coalesce(list_sum(list_filter(w, lambda v: v < 0)), 0.0) AS m FROM w),
t AS (SELECT cand_id, pii_type, round(CASE WHEN coalesce(len(w), 0) = 0 THEN own ELSE greatest(0.0, least(1.0, CASE WHEN p < 1 THEN 1 - p ELSE own END + m)) END, 6) AS score FROM s)
SELECT cand_id, score, CASE WHEN score >= {_CASE(0)} THEN 'CONFIRMED' WHEN score >= {_CASE(1)} THEN 'PROBABLE' ELSE 'UNRESOLVED' END AS verdict FROM t"""

STYLES = f"""WITH {LABELS_CTE}, a AS (SELECT font, color, count(*) AS label_uses FROM lab WHERE font IS NOT NULL GROUP BY ALL),
b AS (SELECT font, color, count(*) AS value_uses FROM l ANTI JOIN lab USING (fixture, page_no, block_no, line_no) WHERE font IS NOT NULL GROUP BY ALL)
SELECT font, color, label_uses, coalesce(value_uses, 0) AS value_uses FROM a LEFT JOIN b USING (font, color) WHERE label_uses >= 5 AND coalesce(value_uses, 0) <= label_uses"""

NAME_TOKENS = f"""{CANDS}, ct AS (SELECT cand_id, fixture, label_confirmed, unnest(list_distinct(string_split({fold('text')}, ' '))) AS token FROM c WHERE pii_type = 'PERSON' AND text IS NOT NULL),
nt AS (SELECT fixture, token, count(*) AS n FROM ct WHERE label_confirmed AND length(token) >= 2 GROUP BY ALL)"""
ALL_CONFIRMED = f"""WITH {NAME_TOKENS} SELECT cand_id FROM ct LEFT JOIN nt USING (fixture, token) WHERE NOT label_confirmed AND length(token) >= 2
GROUP BY cand_id HAVING bool_and(nt.n IS NOT NULL)"""

GAPS = f"""WITH {CANDS}, g AS (SELECT pii_type, list_sort(list(DISTINCT source)) AS s, count(*) AS n FROM c WHERE pii_type IS NOT NULL GROUP BY ALL)
SELECT pii_type, array_to_string(s, ',') AS sources, n, array_to_string(list_filter(['audit', 'coverage', 'group', 'manual', 'ner', 'regex'], lambda v: NOT list_contains(s, v)), ',') AS missing FROM g"""

METRICS = f"""WITH {CANDS}, got AS (SELECT DISTINCT fixture, pii_type, {NORM_TEXT} AS value, 1 AS got FROM c WHERE text IS NOT NULL AND pii_type IS NOT NULL),
want AS (SELECT fixture, pii_type, {NORM_TEXT} AS value, max(CASE WHEN state = 'approved' THEN 1 WHEN state IS NULL THEN NULL ELSE 0 END) AS want FROM expected_decisions WHERE text IS NOT NULL AND pii_type IS NOT NULL GROUP BY ALL),
k AS (SELECT pii_type, CAST(sum(CASE WHEN got = 1 AND want = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN got = 1 AND want = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
CAST(sum(CASE WHEN got IS NULL AND want = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM want LEFT JOIN got USING (fixture, pii_type, value) GROUP BY pii_type)
SELECT pii_type, tp, fp, fn, round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(tp + fn, 0), 4) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 4) AS f1 FROM k"""

# Joins and windows

_REG = "reg AS (SELECT DISTINCT record_id, scope_ref, pii_type, normalized, discriminator, original, pseudonym FROM registry)"
_LOW = f"lower(trim(regexp_replace(original, '{_BLANKS}', ' ', 'g'), ' '))"
ROSTER_LOOKUP = f"""WITH {_REG}, k AS (SELECT pii_type, {_LOW} AS k, min(pseudonym) AS kept FROM roster WHERE coalesce(pseudonym, '') <> '' GROUP BY ALL)
SELECT record_id, coalesce(pseudonym, kept) AS pseudonym, kept IS NOT NULL AS known FROM (SELECT *, {_LOW} AS k FROM reg) r LEFT JOIN k USING (pii_type, k)"""

WINDOWS = r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\r\n\f\v]+') AS w FROM documents),
k AS (SELECT doc_id, w, unnest(range(0, greatest(1, CAST(floor((len(w) - 1) / 98.0) AS BIGINT) + 1))) AS chunk FROM w WHERE len(w) > 0)
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, len(w[chunk * 98 + 1:chunk * 98 + 110]) AS n_words, array_to_string(w[chunk * 98 + 1:chunk * 98 + 110], ' ') AS chunk_text FROM k"""

FIRST_SEEN = f"""WITH {CANDS}, s AS (SELECT fixture, pii_type, {NORM_TEXT} AS value, min({{'p': page_no, 'b': block_no, 'l': line_no, 's': span_start, 'c': cand_id}}) AS p
FROM c WHERE text IS NOT NULL AND pii_type IS NOT NULL GROUP BY ALL)
SELECT fixture, pii_type, value, row_number() OVER (PARTITION BY fixture ORDER BY p.p, p.b, p.l, p.s, p.c) AS rank FROM s"""

SEARCH = f"""WITH {CANDS}, h AS (SELECT DISTINCT hit_id, fixture, page_no, line_text FROM search_hits WHERE line_text IS NOT NULL AND page_no IS NOT NULL),
v AS (SELECT DISTINCT fixture, page_no, text FROM c WHERE text IS NOT NULL AND text <> '')
SELECT hit_id, CAST(sum(CASE WHEN contains(line_text, text) THEN 1 ELSE 0 END) AS BIGINT) AS touched FROM h LEFT JOIN v USING (fixture, page_no) GROUP BY hit_id"""

# Scalar functions

_STREET = "map([" + listed(X.STREET_SHORT) + "], [" + listed(X.STREET_SHORT.values()) + "])"
_REGNORM = f"array_to_string(list_transform(string_split(lower({NORM}), ' '), lambda v: coalesce({_STREET}[v], v)), ' ')"
_SUFFIX = "|".join(s.replace(".", "\\.") for s in X.LEGAL_SUFFIXES)
_TOKENS = f"array_to_string(list_transform(string_split(lower({NORM}), ' '), lambda v: trim(v, '.,;:')), ' ')"
_ORG = f"CASE WHEN trim(regexp_replace({_TOKENS}, '(( |^)({_SUFFIX}))+$', ''), ' ') = '' THEN lower({NORM}) ELSE trim(regexp_replace({_TOKENS}, '(( |^)({_SUFFIX}))+$', ''), ' ') END"
KEYS = f"""WITH {CANDS} SELECT cand_id, CASE WHEN pii_type IN ('STREET', 'ADDRESS') AND regexp_matches(text, '^[ \\t\\r\\n]*[0-9]') THEN 'ADDRESS' ELSE pii_type END AS key_type,
CASE WHEN pii_type IN ({listed(X.DIGIT_KEYED)}) AND regexp_replace(text, '[^0-9]', '', 'g') <> '' THEN regexp_replace(text, '[^0-9]', '', 'g')
WHEN pii_type = 'ORG_PRIVATE' THEN {_ORG} WHEN pii_type = 'PERSON' THEN {fold('text')} ELSE {_REGNORM} END AS key FROM c WHERE text IS NOT NULL"""

_WORDS = f"list_filter(string_split_regex(lower({COLLAPSED}), '[^\\p{{L}}]+'), lambda v: v <> '')"
_T = "t"
PERSON_SHAPE = f"""WITH {CANDS}, k AS (SELECT cand_id, {COLLAPSED} AS t, {_WORDS} AS w FROM c WHERE text IS NOT NULL),
s AS (SELECT cand_id, CASE WHEN length(t) > 60 OR len(w) = 0 OR list_has_any(w, [{listed(FORM_WORDS)}]) OR regexp_matches(t, '[0-9@]') THEN 0.0
WHEN length(t) >= 4 AND regexp_matches(t, {q(f'^{N._CAPS}( {N._CAPS}){{1,3}}$')}) THEN 0.72
WHEN length(t) >= 4 AND regexp_matches(t, {q('^[' + chr(92) + 'p{Lu}]{3,}$')}) THEN 0.55
WHEN length(t) >= 4 AND regexp_matches(t, {q(rf'^{N._UP}( {N._UP})?, ?{N._UP}( \p{{Lu}}\.?)?$')}) AND regexp_extract(t, ', ?(.*)$', 1) NOT IN ({listed(N.STATE_CODES)}) THEN 0.75
WHEN length(t) >= 4 AND regexp_matches(t, {q(f'^{N._UP}( {N._UP}){{1,3}}$')}) THEN 0.62
WHEN length(t) >= 4 AND regexp_matches(t, {q(rf'^{N._UP}( ({N._UP}|\p{{Lu}}\.)){{1,3}}$')}) THEN 0.58
WHEN regexp_matches(t, {q('^' + chr(92) + 'p{Lo}{2,12}$')}) THEN 0.52 ELSE 0.0 END AS confidence FROM k)
SELECT cand_id, confidence > 0 AS is_person, CAST(confidence AS DOUBLE) AS confidence FROM s"""

PARSED = f"""WITH {CANDS}, k AS (SELECT cand_id, regexp_replace(regexp_replace({COLLAPSED}, {q(rf'(?i)^(({N.TITLES})\.? )+')}, ''), {q(rf'(?i)(,? ?\b({N.SUFFIXES})\.?)+$')}, '') AS t
FROM c WHERE pii_type = 'PERSON' AND text IS NOT NULL),
w AS (SELECT *, contains(t, ',') AS comma, list_filter(string_split(t, ' '), lambda v: v <> '') AS words FROM k)
SELECT cand_id, CASE WHEN comma THEN array_to_string(list_filter(string_split(trim(split_part(t, ',', 2), ' '), ' '), lambda v: v <> ''), ' ') ELSE array_to_string(words[1:greatest(len(words) - 1, 0)], ' ') END AS given,
CASE WHEN comma THEN trim(split_part(t, ',', 1), ' ') ELSE words[-1] END AS surname, comma AS surname_first FROM w"""

_SEED = f"concat_ws('|', scope_ref, pii_type, {_LOW})"
SEEDS = f"WITH {_REG} SELECT record_id, CASE WHEN original IS NULL THEN CAST(CAST(('0x' || substr(sha256(concat_ws('|', scope_ref, pii_type)), 1, 16)) AS UBIGINT) AS VARCHAR) ELSE CAST(CAST(('0x' || substr(sha256({_SEED}), 1, 16)) AS UBIGINT) AS VARCHAR) END AS seed FROM reg"
MASKED = f"""WITH {_REG}, s AS (SELECT record_id, original, sha256(CAST(CAST(('0x' || substr(sha256({_SEED}), 1, 16)) AS UBIGINT) AS VARCHAR)) AS d FROM reg WHERE original IS NOT NULL),
t AS (SELECT record_id, d, p[k] AS token, k FROM (SELECT *, unnest(range(1, len(p) + 1)) AS k FROM (SELECT *, regexp_extract_all(original, '{_BLANKS}|[^ \\t\\r\\n\\f\\v]+') AS p FROM s))),
ch AS (SELECT record_id, d, k, j, token, substr(token, j, 1) AS ch FROM (SELECT *, unnest(range(1, length(token) + 1)) AS j FROM t)),
f AS (SELECT *, regexp_matches(token, '[0-9]') AND regexp_matches(ch, '^[0-9A-Za-z]$') AS hit FROM ch),
n AS (SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY record_id ORDER BY k, j) - 1 AS i FROM f),
b AS (SELECT *, CASE WHEN hit THEN CAST(('0x' || substr(d, CAST((i % 32) * 2 + 1 AS BIGINT), 2)) AS INTEGER) END AS b FROM n)
SELECT record_id, string_agg(CASE WHEN NOT hit THEN ch WHEN regexp_matches(ch, '[0-9]') THEN CAST(b % 10 AS VARCHAR) WHEN regexp_matches(ch, '[A-Z]') THEN chr(b % 26 + 65) ELSE chr(b % 26 + 97) END, '' ORDER BY k, j) AS masked
FROM b GROUP BY record_id"""

RECTS = f"""WITH {LINES}, b AS (SELECT fixture, page_no, block_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, round(sum((x1 - x0) * (y1 - y0)), 2) AS covered FROM l GROUP BY ALL)
SELECT *, round(covered / nullif((x1 - x0) * (y1 - y0), 0), 4) AS share FROM b"""

COMPONENTS = f"""WITH RECURSIVE {CANDS}, e AS (SELECT a.cand_id AS a, b.cand_id AS b FROM c a JOIN c b USING (fixture, page_no, block_no, line_no)
UNION SELECT a.cand_id, b.cand_id FROM c a JOIN c b ON a.fixture = b.fixture AND a.group_id = b.group_id),
r(a, b) AS (SELECT cand_id, cand_id FROM c UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS cand_id, min(b) AS component FROM r GROUP BY a"""

# Cleaning

TRIMMED = f"""WITH {CANDS}, h AS (SELECT cand_id, span_start, text, length(regexp_extract(text, {q(rf'(?i)^((?:{N.TITLES})\.? +)')}, 1)) AS n FROM c WHERE pii_type = 'PERSON' AND text IS NOT NULL),
v AS (SELECT cand_id, CAST(span_start + n AS INTEGER) AS span_start, regexp_replace(substr(text, n + 1), '[''\u2019][sS]$', '') AS value FROM h)
SELECT cand_id, span_start, CAST(span_start + length(value) AS INTEGER) AS span_end, value FROM v WHERE value <> ''"""
COMPOUNDS = f"""WITH {CANDS}, p AS (SELECT cand_id, string_split_regex({COLLAPSED}, '(?i) (?:&|and|\\+) ') AS p FROM c WHERE pii_type = 'PERSON' AND text IS NOT NULL),
k AS (SELECT cand_id, p, i, p[i] AS part, string_split(p[-1], ' ')[-1] AS last FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM p) WHERE len(p) > 1)
SELECT cand_id, CAST(i - 1 AS INTEGER) AS part_no, CASE WHEN contains(trim(part, ' '), ' ') THEN trim(part, ' ') ELSE trim(part, ' ') || ' ' || last END AS part FROM k"""
_J = r"(\p{Lu}[\p{L}'\x{2019}-]+) (?:&|and) (\p{Lu}[\p{L}'\x{2019}-]+(?: \p{Lu}\.?)?) (\p{Lu}[\p{L}'\x{2019}-]+)"
JOINT = f"WITH {LINES} SELECT {KEY}, regexp_extract(text, {q(_J)}, 1) AS first, regexp_extract(text, {q(_J)}, 2) AS second, regexp_extract(text, {q(_J)}, 3) AS surname FROM l WHERE regexp_matches(text, {q(_J)})"
LABEL_TEXTS = f"""WITH {CANDS}, {LABELS_CTE}, v AS (SELECT DISTINCT fixture, {NORM_TEXT.replace('(text,', '(label,')} AS v FROM lab)
SELECT cand_id FROM (SELECT *, {NORM_TEXT} AS v FROM c WHERE text IS NOT NULL) SEMI JOIN (SELECT * FROM v WHERE v <> '') USING (fixture, v)"""
SENSITIVE = f"""WITH p AS ({PERSON_SHAPE}), {CANDS} SELECT cand_id, regexp_matches(text, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{{2,}}') OR is_person
OR regexp_matches(text, '(?i)[0-9]+ .*\\b(street|st|avenue|ave|road|rd|drive|dr|lane|ln|court|ct)\\b') OR regexp_matches(text, ', [A-Z]{{2}}\\b')
OR length(regexp_replace(text, '[^0-9]', '', 'g')) >= 5 AS sensitive FROM c JOIN p USING (cand_id) WHERE text IS NOT NULL"""
_LONG = lambda x: f"list_filter(string_split({fold(x)}, ' '), lambda v: length(v) >= 3)"
LEAKING = f"""WITH {_REG}, k AS (SELECT record_id, CASE WHEN coalesce(trim(pseudonym, ' '), '') = '' THEN 'empty' WHEN {fold('pseudonym')} = {fold('original')} THEN 'identical'
WHEN list_has_any({_LONG('pseudonym')}, {_LONG('original')}) THEN 'shares a word' END AS problem FROM reg WHERE original IS NOT NULL) SELECT * FROM k WHERE problem IS NOT NULL"""
VARIANTS = f"""WITH {CANDS}, n AS (SELECT DISTINCT fixture, {NORM} AS name FROM c WHERE pii_type = 'PERSON' AND text IS NOT NULL),
k AS (SELECT fixture, name, regexp_replace(regexp_replace({COLLAPSED.replace('(text,', '(name,')}, {q(rf'(?i)^(({N.TITLES})\.? )+')}, ''), {q(rf'(?i)(,? ?\b({N.SUFFIXES})\.?)+$')}, '') AS t FROM n),
w AS (SELECT *, contains(t, ',') AS comma, list_filter(string_split(t, ' '), lambda v: v <> '') AS words FROM k),
g AS (SELECT fixture, name, CASE WHEN comma THEN list_filter(string_split(trim(split_part(t, ',', 2), ' '), ' '), lambda v: v <> '') ELSE words[1:greatest(len(words) - 1, 0)] END AS given,
CASE WHEN comma THEN trim(split_part(t, ',', 1), ' ') ELSE words[-1] END AS surname FROM w),
o AS (SELECT fixture, name, unnest(list_distinct([array_to_string(given, ' ') || ' ' || surname, surname || ', ' || array_to_string(given, ' '),
trim(array_to_string(list_filter(given, lambda v: length(replace(v, '.', '')) > 1), ' ') || ' ' || surname, ' '), replace(array_to_string(given, ' ') || ' ' || surname, '-', ' ')])) AS variant
FROM g WHERE surname <> '' AND len(given) > 0) SELECT * FROM o WHERE length(variant) >= 4 AND variant <> name"""
SUBJECTS = f"""WITH {CANDS}, r AS (SELECT fixture, pii_type, {NORM_TEXT} AS value, coalesce(confidence, 0.0) AS confidence, cand_id FROM c WHERE text IS NOT NULL AND pii_type IS NOT NULL AND length(text) >= 4)
SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY fixture, pii_type, value ORDER BY confidence DESC, cand_id) = 1"""
SUFFIXED = f"""WITH {CANDS}, s AS (SELECT cand_id, lower(regexp_extract(trim(text, ' '), {q(rf'(?i)[ ,]({N.SUFFIXES})\.?$')}, 1)) AS suffix FROM c WHERE pii_type = 'PERSON' AND text IS NOT NULL)
SELECT * FROM s WHERE suffix <> ''"""


def SENSITIVE_OF(x: str) -> str:  # noqa: N802
    """SQL of whether the value ``x`` looks sensitive."""
    t = f"trim(regexp_replace({x}, '{_BLANKS}', ' ', 'g'), ' ')"
    words = f"list_filter(string_split_regex(lower({t}), '[^\\p{{L}}]+'), lambda v: v <> '')"
    shapes = [f"^{N._CAPS}( {N._CAPS}){{1,3}}$", r"^[\p{Lu}]{3,}$", f"^{N._UP}( {N._UP}){{1,3}}$", rf"^{N._UP}( ({N._UP}|\p{{Lu}}\.)){{1,3}}$"]
    surname_first = f"(regexp_matches({t}, {q(rf'^{N._UP}( {N._UP})?, ?{N._UP}( ' + chr(92) + 'p{Lu}' + chr(92) + '.?)?$')}) AND regexp_extract({t}, ', ?(.*)$', 1) NOT IN ({listed(N.STATE_CODES)}))"
    named = " OR ".join([*(f"regexp_matches({t}, {q(s)})" for s in shapes), surname_first])
    caseless = f"regexp_matches({t}, {q('^' + chr(92) + 'p{Lo}{2,12}$')})"
    person = f"(length({t}) <= 60 AND len({words}) > 0 AND NOT list_has_any({words}, [{listed(FORM_WORDS)}]) AND NOT regexp_matches({t}, '[0-9@]') AND ((length({t}) >= 4 AND ({named})) OR {caseless}))"
    return (
        f"(regexp_matches({x}, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{{2,}}') OR {person} "
        f"OR regexp_matches({x}, '(?i)[0-9]+ .*\\b(street|st|avenue|ave|road|rd|drive|dr|lane|ln|court|ct)\\b') OR regexp_matches({x}, ', [A-Z]{{2}}\\b') "
        f"OR length(regexp_replace({x}, '[^0-9]', '', 'g')) >= 5)"
    )
