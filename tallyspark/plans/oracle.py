"""The statement queries in DuckDB SQL, written as common table expressions that build on each other."""

from __future__ import annotations

from ..config import ROLE_PRIORITY, Settings
from ..functions.text import AMOUNT, CREDIT_SIGN, DATES, DEBIT_SIGN, NOISE, NOISE_WORDS, NUMBERS, REFERENCES
from .statements import HEADINGS, LINES, OPENING_CENTS, PLACES, WORDS

S = Settings()


def text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(text(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def is_amount(x: str) -> str:
    return f"regexp_matches({strip(x)}, {text(AMOUNT)})"


def is_date(x: str) -> str:
    return f"(NOT regexp_matches({strip(x)}, '^\\d{{7,}}$') AND ({' OR '.join(f'regexp_matches({strip(x)}, {text(p)})' for p in DATES)}))"


def is_reference(x: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({strip(x)}, {text(p)})" for p in REFERENCES) + ")"


def first_of(x: str, patterns: tuple[str, ...]) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({x}, {text(p)}), '')" for p in patterns) + ")"


def value(x: str) -> str:
    return f"CASE WHEN {is_amount(x)} THEN TRY_CAST(regexp_replace({strip(x)}, '[^\\d.]', '', 'g') AS DOUBLE) END"


def sign(x: str) -> str:
    return f"CASE WHEN {value(x)} IS NOT NULL THEN CASE WHEN starts_with({strip(x)}, '-') THEN 'debit' WHEN regexp_matches({x}, {text(CREDIT_SIGN)}) THEN 'credit' WHEN regexp_matches({x}, {text(DEBIT_SIGN)}) THEN 'debit' ELSE 'unknown' END END"


def digits(x: str) -> str:
    return f"regexp_matches(replace({x}, ' ', ''), '^\\d{{8,}}$')"


def plain(x: str) -> str:
    cut = f"regexp_replace(CAST(CAST({x} AS DECIMAL(30,6)) AS VARCHAR), '0+$', '')"
    whole = f"{x} = floor({x}) AND abs({x}) < 1e18"  # such doubles don't survive the cast to decimals
    return f"CASE WHEN {whole} THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) || '.0' WHEN {cut} LIKE '%.' THEN {cut} || '0' ELSE {cut} END"


def printed(c: str) -> str:
    return f"(CASE WHEN {c} < 0 THEN '-' ELSE '' END || format('{{:,}}', abs({c}) // 100) || '.' || lpad(CAST(abs({c}) % 100 AS VARCHAR), 2, '0'))"


def token(slot: int, what: str, order: str, y: str, when: str) -> str:
    return f"SELECT doc_id, k, page_num, {slot} AS slot, {what} AS text, CAST({order} AS INTEGER) AS token_ord, CAST({y} AS INTEGER) AS y FROM paged WHERE {when}"


Y = "100 + 40 * line"
TOKENS = [
    token(0, "' ' || day", "10 + line * 10", Y, "k % 19 <> 0"),
    token(1, f"[{', '.join(map(text, WORDS))}][k % 4 + 1] || ' '", "11 + line * 10", Y, "true"),
    token(2, "CASE WHEN doc_id % 3 = 0 THEN '40000000' || lpad(CAST(k AS VARCHAR), 8, '0') ELSE 'UTRN' || lpad(CAST(k AS VARCHAR), 12, '0') END", "12 + line * 10", Y, "doc_id % 3 < 2"),
    token(3, f"{printed('cents')} || CASE WHEN k % 23 = 0 THEN ' DR' ELSE '' END", "13 + line * 10", Y, "NOT is_credit"),
    token(4, f"{printed('cents')} || CASE WHEN k % 23 = 0 THEN ' CR' ELSE '' END", "14 + line * 10", Y, "is_credit"),
    token(5, printed("shown_cents"), "15 + line * 10", Y, "shown_cents IS NOT NULL"),
    token(1, "'cont ' || k", "16 + line * 10", f"{Y} + 21", "line % 5 = 4 AND line >= 9"),
    token(1, "'Summary of page'", "1000", "930", "line = 0"),
    token(2, "'123456789012'", "1001", "960", "line = 0"),
    *[token(slot, text(word), str(slot), "60", f"line = 0 AND doc_id % 4 = {i}") for i, kind in enumerate(HEADINGS) for slot, word in enumerate(kind)],
]

VOCABULARY = values([(r, i, j, w.lower()) for i, r in enumerate(ROLE_PRIORITY) for j, w in enumerate(S.vocabulary[r])])
ZONE = "doc_id, column_id, x_center, left_boundary, right_boundary, support, semantic_role"


def lcs(a: str, b: str) -> str:
    """The length of the longest common subsequence, row by row."""
    row = f"list_prepend([CAST(0 AS BIGINT)], list_transform(range(1, len({b}) + 1), lambda j: [CAST(j AS BIGINT)]))"
    start = f"list_transform(range(0, len({b}) + 1), lambda i: CAST(0 AS BIGINT))"
    rows = f"list_prepend({start}, list_transform(range(1, len({a}) + 1), lambda i: [CAST(i AS BIGINT)]))"
    step = f"list_append(acc, CASE WHEN {a}[x[1]] = {b}[j[1]] THEN prev[j[1]] + 1 ELSE greatest(prev[j[1] + 1], acc[-1]) END)"
    return f"list_last(list_reduce({rows}, lambda prev, x: list_reduce({row}, lambda acc, j: {step})))"


def give(source: str, role: str, order: str, condition: str) -> str:
    """source with role for the first band by order that has none, if the document lacks it."""
    return (
        f"SELECT * REPLACE (CASE WHEN semantic_role IS NULL AND NOT had AND rn = 1 AND {condition} THEN '{role}' ELSE semantic_role END AS semantic_role) FROM ("
        f"SELECT {ZONE}, coalesce(bool_or(semantic_role = '{role}') OVER (PARTITION BY doc_id), false) AS had, "
        f"row_number() OVER (PARTITION BY doc_id ORDER BY semantic_role IS NOT NULL, {order}) AS rn FROM {source})"
    )


def positional(name: str, source: str) -> list[tuple[str, str]]:
    """The CTEs from source to name."""
    wide = "(right_boundary - left_boundary)"
    rest = (
        f"SELECT {ZONE.replace('semantic_role', '')} coalesce(semantic_role, CASE WHEN rn = 1 AND d = 1 THEN 'debit' WHEN rn = d + 1 AND c = 1 THEN 'credit' END) AS semantic_role FROM ("
        f"SELECT {ZONE}, CASE WHEN coalesce(bool_or(semantic_role = 'debit') OVER p, false) THEN 0 ELSE 1 END AS d, CASE WHEN coalesce(bool_or(semantic_role = 'credit') OVER p, false) THEN 0 ELSE 1 END AS c, "
        f"row_number() OVER (PARTITION BY doc_id ORDER BY semantic_role IS NOT NULL, x_center DESC, column_id) AS rn FROM {name}_3 WINDOW p AS (PARTITION BY doc_id))"
    )
    return [
        (f"{name}_1", give(source, "date", "x_center, column_id", f"x_center < {S.date_before}")),
        (f"{name}_2", give(f"{name}_1", "balance", "x_center DESC, column_id", "true")),
        (f"{name}_3", give(f"{name}_2", "narration", f"{wide} DESC, column_id", f"{wide} > {S.narration_wider}")),
        (name, rest),
    ]


def swapped(source: str) -> str:
    first = lambda role: f"arg_min(x_center, column_id) FILTER (WHERE semantic_role = '{role}') OVER (PARTITION BY doc_id)"
    own = lambda role: f"min(column_id) FILTER (WHERE semantic_role = '{role}') OVER (PARTITION BY doc_id)"
    return (
        f"SELECT {ZONE.replace('semantic_role', '')} CASE WHEN dx > cx AND column_id = di THEN 'credit' WHEN dx > cx AND column_id = ci THEN 'debit' ELSE semantic_role END AS semantic_role FROM ("
        f"SELECT {ZONE}, {first('debit')} AS dx, {first('credit')} AS cx, {own('debit')} AS di, {own('credit')} AS ci FROM {source})"
    )


def pipeline(tokens: str, given: str, end: str = "") -> list[tuple[str, str]]:
    """From bands with roles to results; end is added to the names."""
    return [
        (f"assigned{end}", f"SELECT m.*, coalesce(column_id, -1) AS column_id, coalesce(semantic_role, 'unknown') AS role FROM merged m LEFT JOIN (SELECT * FROM ("
            f"SELECT m.doc_id, m.page_num, m.token_ord, z.column_id, z.semantic_role, normalized_x BETWEEN left_boundary AND right_boundary OR abs(normalized_x - x_center) <= {S.near_zone} AS near, "
            f"row_number() OVER (PARTITION BY m.doc_id, m.page_num, m.token_ord ORDER BY abs(normalized_x - x_center), z.column_id) AS rn FROM merged m JOIN {given} z USING (doc_id)) WHERE rn = 1 AND near) n USING (doc_id, page_num, token_ord)"),
        (f"routed{end}", f"SELECT *, CASE WHEN role <> 'unknown' THEN role WHEN is_date THEN 'date' WHEN NOT is_numeric THEN 'narration' ELSE 'unknown' END AS bucket FROM assigned{end}"),
        (f"parsed{end}", f"SELECT *, {first_of('text', DATES)} AS d, {first_of('text', REFERENCES)} AS f, {value('text')} AS v, row_number() OVER (PARTITION BY doc_id, page_num, row_id ORDER BY normalized_x, pos) AS xr FROM routed{end} WHERE NOT is_header"),
        (f"assembled{end}", "SELECT doc_id, page_num, row_id, string_agg(text, ' ' ORDER BY normalized_x, pos) AS full_text, bool_or(is_numeric) AS has_numeric, avg(confidence) AS mean_confidence, "
            "bool_or(bucket = 'date' OR (bucket = 'narration' AND is_date)) AS has_date, bool_or(bucket IN ('debit', 'credit', 'balance', 'unknown') AND is_numeric) AS has_amount, "
            f"arg_min(d, pos) FILTER (WHERE d IS NOT NULL AND bucket = 'date' AND NOT {digits('d')}) AS date_1, arg_min(d, xr) FILTER (WHERE d IS NOT NULL AND NOT {digits('d')}) AS date_2, arg_min(d, pos) FILTER (WHERE d IS NOT NULL AND bucket = 'narration') AS date_3, "
            "arg_min(f, pos) FILTER (WHERE f IS NOT NULL AND bucket = 'reference') AS ref_1, arg_min(f, pos) FILTER (WHERE f IS NOT NULL AND bucket = 'narration') AS ref_2, "
            + "".join(f"arg_min(v, pos) FILTER (WHERE v IS NOT NULL AND bucket = '{b}') AS {b}_0, " for b in ("debit", "credit", "balance"))
            + "count(v) FILTER (WHERE bucket = 'unknown' AND is_numeric) AS n_loose, arg_min(v, pos) FILTER (WHERE v IS NOT NULL AND bucket = 'unknown' AND is_numeric) AS loose_first, "
            "arg_min_null(v, xr) FILTER (WHERE bucket = 'unknown' AND is_numeric) AS loose_left, arg_max_null(v, xr) FILTER (WHERE bucket = 'unknown' AND is_numeric) AS loose_right, "
            f"list({strip('text')} ORDER BY pos) FILTER (WHERE bucket = 'narration' AND NOT is_numeric) AS words FROM parsed{end} GROUP BY ALL"),
        (f"distributed{end}", "SELECT *, CASE WHEN bare AND n_loose > 1 THEN loose_left WHEN moved THEN loose_first ELSE debit_0 END AS debit, credit_0 AS credit, CASE WHEN bare AND n_loose = 1 THEN loose_first WHEN bare THEN loose_right ELSE balance_0 END AS balance "
            f"FROM (SELECT *, debit_0 IS NULL AND credit_0 IS NULL AND balance_0 IS NULL AND n_loose > 0 AS bare, debit_0 IS NULL AND credit_0 IS NULL AND balance_0 IS NOT NULL AND n_loose > 0 AS moved FROM assembled{end})"),
        (f"described{end}", "SELECT *, nullif(list_aggregate(list_filter(words, lambda w: w <> '' AND coalesce(w <> txn_date, true) AND coalesce(w <> reference_no, true)), 'string_agg', ' '), '') AS description FROM ("
            f"SELECT *, coalesce(date_1, date_2, date_3, {first_of('full_text', DATES)}) AS txn_date, coalesce(ref_1, ref_2) AS reference_no FROM distributed{end})"),
        (f"raw_txns{end}", "SELECT doc_id, page_num, row_id, txn_date, description, reference_no, debit, credit, balance, round(greatest(0.0, least(1.0, mean_confidence)), 4) AS confidence_score, 'needs_review' AS validation_status, full_text AS raw_text "
            f"FROM described{end} WHERE NOT {noise('full_text', 'has_numeric')} AND (has_date OR has_amount) AND coalesce(balance, debit, credit) IS NOT NULL AND (description IS NOT NULL OR txn_date IS NOT NULL OR balance IS NOT NULL)"),
        *validated(f"raw_txns{end}", f"txns{end}"),
        (f"mapping{end}", f"SELECT doc_id, string_agg(column_id || '=' || semantic_role, ',' ORDER BY column_id) AS column_mapping FROM {given} GROUP BY doc_id"),
    ]


def noise(x: str, numeric: str) -> str:
    t = strip(x)
    words = ", ".join(map(text, NOISE_WORDS))
    return f"({t} = '' OR regexp_matches({t}, {text(NOISE)}) OR upper({t}) IN ({words}) OR (contains(upper({t}), 'DESCRIPTION') AND contains(upper({t}), 'DATE') AND NOT {numeric}) OR {digits(t)})"


def validated(source: str, name: str) -> list[tuple[str, str]]:
    line = "PARTITION BY doc_id ORDER BY page_num, row_id"
    opening = "CASE WHEN o.debit IS NOT NULL AND o.debit <> 0 THEN o.balance + o.debit WHEN o.credit IS NOT NULL AND o.credit <> 0 THEN o.balance - o.credit ELSE o.balance END"
    return [
        (f"{name}_carried", f"SELECT *, count(balance) OVER (PARTITION BY doc_id) AS n_balances, last_value(balance IGNORE NULLS) OVER ({line} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried, "
            f"first_value(CASE WHEN balance IS NOT NULL THEN {{'balance': balance, 'debit': debit, 'credit': credit}} END IGNORE NULLS) OVER ({line} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS o FROM {source}"),
        (f"{name}_expected", f"SELECT *, CASE WHEN debit IS NOT NULL OR credit IS NOT NULL THEN prev_balance + coalesce(credit, 0.0) - coalesce(debit, 0.0) END AS expected FROM (SELECT *, {opening} AS opening, coalesce(carried, {opening}) AS prev_balance FROM {name}_carried)"),
        (name, "SELECT doc_id, page_num, row_id, txn_date, description, reference_no, debit, credit, balance, CASE status WHEN 'needs_review' THEN confidence_score WHEN 'validated' THEN least(1.0, confidence_score + 0.15) ELSE greatest(0.0, confidence_score - 0.20) END AS confidence_score, status AS validation_status, raw_text FROM ("
            f"SELECT *, CASE WHEN n_balances < 2 OR balance IS NULL OR expected IS NULL THEN 'needs_review' WHEN abs(balance - expected) <= 0.01 * greatest(abs(balance), 1.0) THEN 'validated' ELSE 'failed' END AS status FROM {name}_expected)"),
    ]


PAGE = "PARTITION BY doc_id, page_num ORDER BY"
CTES: list[tuple[str, str]] = [
    ("lines", "SELECT o_custkey AS doc_id, o_orderkey AS k, CAST(row_number() OVER w - 1 AS INTEGER) AS seq, cents, is_credit, strftime(o_orderdate, '%d/%m/%Y') AS day, "
        f"CASE WHEN o_orderkey % 11 <> 0 THEN CAST(sum(CASE WHEN is_credit THEN cents ELSE -cents END) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) + {OPENING_CENTS} + CASE WHEN o_orderkey % 17 = 0 THEN 90000000 ELSE 0 END END AS shown_cents "
        "FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderstatus = 'O' AS is_credit FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"),
    ("ledger", f"SELECT doc_id, CAST(seq // {LINES} AS INTEGER) AS page_num, CAST(seq % {LINES} AS INTEGER) AS row_id, day AS txn_date, 'order ' || k AS description, CAST(NULL AS VARCHAR) AS reference_no, "
        "CASE WHEN k % 13 <> 0 AND NOT is_credit THEN cents / 100 END AS debit, CASE WHEN k % 13 <> 0 AND is_credit THEN cents / 100 END AS credit, shown_cents / 100 AS balance, (k % 64) / 64 AS confidence_score, 'needs_review' AS validation_status, day || ' ' || k AS raw_text FROM lines"),
    *validated("ledger", "checked"),
    ("paged", f"SELECT *, CAST(seq // {LINES} AS INTEGER) AS page_num, seq % {LINES} AS line FROM lines"),
    ("raw", f"SELECT doc_id, page_num, token_ord, text, CASE WHEN (k + slot) % 29 = 0 THEN 0.125::DOUBLE ELSE (48 + (k + slot) % 16) / 64 END AS confidence, CAST(x - 20 AS DOUBLE) AS x1, CAST(y - 5 AS DOUBLE) AS y1, CAST(x + 20 AS DOUBLE) AS x2, CAST(y + 5 AS DOUBLE) AS y2, 1000.0::DOUBLE AS width, 1000.0::DOUBLE AS height "
        f"FROM (SELECT * REPLACE (y + (doc_id + slot) % 3 AS y), {list(PLACES)}[slot + 1] + (k + slot) % 3 AS x FROM ({' UNION ALL '.join(TOKENS)}))"),
    ("tokens", f"SELECT doc_id, page_num, token_ord, t AS text, confidence, x1, y1, x2, y2, (x1 + x2) / 2 AS center_x, (y1 + y2) / 2 AS center_y, (x1 + x2) / 2 / width AS normalized_x, (y1 + y2) / 2 / height AS normalized_y, {is_amount('t')} AS is_numeric, {is_date('t')} AS is_date "
        f"FROM (SELECT *, {strip('text')} AS t FROM raw) WHERE confidence >= 0.3 AND width > 0 AND height > 0 AND t <> ''"),
    ("stepped", f"SELECT *, CASE WHEN normalized_y - lag(normalized_y) OVER ({PAGE} normalized_y, token_ord) > {S.row_eps} THEN 1 ELSE 0 END AS new FROM tokens"),
    ("placed", f"SELECT * EXCLUDE (new), CAST(sum(new) OVER ({PAGE} normalized_y, token_ord ROWS UNBOUNDED PRECEDING) AS INTEGER) AS part_id FROM stepped"),
    ("parts_0", f"SELECT *, part_id < {S.header_rows} AND NOT has_amount AND has_word AS is_header FROM (SELECT doc_id, page_num, part_id, avg(normalized_y) AS y_center, bool_or(is_numeric) AS has_amount, bool_or(is_numeric OR is_date) AS has_number, "
        "bool_or(length(text) > 2 AND NOT regexp_matches(regexp_replace(text, '[,.]', '', 'g'), '^\\d+$')) AS has_word, count(*) AS n_tokens FROM placed GROUP BY ALL)"),
    ("parts_1", f"SELECT *, coalesce(NOT is_header AND NOT lag(is_header) OVER w AND NOT has_number AND y_center - lag(y_center) OVER w <= {S.continuation_gap}, false) AS is_continuation FROM parts_0 WINDOW w AS ({PAGE} part_id)"),
    ("parts", f"SELECT doc_id, page_num, part_id, y_center, n_tokens, is_header, is_continuation, max(CASE WHEN NOT is_continuation THEN part_id END) OVER ({PAGE} part_id ROWS UNBOUNDED PRECEDING) AS row_id FROM parts_1"),
    ("merged", "SELECT * EXCLUDE (is_merged), CAST(row_number() OVER (PARTITION BY doc_id, page_num, row_id ORDER BY CASE WHEN is_merged THEN normalized_y END, normalized_x, part_id, token_ord) AS INTEGER) AS pos FROM ("
        "SELECT p.*, r.row_id, r.is_header, bool_or(r.is_continuation) OVER (PARTITION BY p.doc_id, p.page_num, r.row_id) AS is_merged FROM placed p JOIN parts r USING (doc_id, page_num, part_id))"),
    ("full_texts", "SELECT doc_id, page_num, row_id, string_agg(text, ' ' ORDER BY normalized_x, pos) AS full_text, bool_or(is_numeric) AS has_numeric, any_value(is_header) AS is_header, count(*) AS n_tokens FROM merged GROUP BY ALL"),
    ("numbers", f"SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY normalized_x, page_num, row_id, pos ROWS UNBOUNDED PRECEDING) AS label FROM (SELECT doc_id, page_num, row_id, pos, normalized_x, CASE WHEN normalized_x - lag(normalized_x) OVER (PARTITION BY doc_id ORDER BY normalized_x, page_num, row_id, pos) > {S.column_eps} THEN 1 ELSE 0 END AS new FROM merged WHERE NOT is_header AND (is_numeric OR is_date))"),
    ("zones", "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY x_center, label) - 1 AS INTEGER) AS column_id, x_center, left_boundary, right_boundary, support, CAST(NULL AS VARCHAR) AS semantic_role FROM ("
        f"SELECT doc_id, label, median(normalized_x) AS x_center, greatest(0.0, min(normalized_x) - {S.boundary_padding}) AS left_boundary, least(1.0, max(normalized_x) + {S.boundary_padding}) AS right_boundary, count(*) AS support FROM numbers GROUP BY ALL HAVING count(*) >= {S.column_support})"),
    # a document's bands as one list, looked through after the join by doc_id: no range is left to join by
    ("headed", "SELECT doc_id, page_num, row_id, pos, text, normalized_x, b.id AS column_id FROM (SELECT m.doc_id, page_num, row_id, pos, text, normalized_x, unnest(bands) AS b FROM merged m "
        "JOIN (SELECT doc_id, list({'id': column_id, 'l': left_boundary, 'r': right_boundary}) AS bands FROM zones GROUP BY doc_id) z ON z.doc_id = m.doc_id WHERE is_header) WHERE normalized_x >= b.l AND normalized_x <= b.r"),
    ("zone_texts", "SELECT doc_id, column_id, trim(lower(string_agg(text, ' ' ORDER BY page_num, row_id, pos))) AS zone_text FROM headed GROUP BY ALL"),
    ("vocabulary", f"SELECT * FROM (VALUES {VOCABULARY}) AS v(role, priority, ord, keyword)"),
    ("simple", f"SELECT {ZONE.replace('semantic_role', '').replace('doc_id, column_id', 'z.doc_id, z.column_id')} w.role AS semantic_role FROM zones z LEFT JOIN (SELECT doc_id, column_id, arg_min(role, priority) AS role FROM zone_texts JOIN vocabulary ON contains(zone_text, keyword) GROUP BY ALL) w ON w.doc_id = z.doc_id AND w.column_id = z.column_id"),
    # the shorter text, each window of the longer, both ways round for equal lengths
    ("sides", "SELECT DISTINCT zone_text, keyword, CASE WHEN len(zone_text) <= len(keyword) THEN zone_text ELSE keyword END AS a, CASE WHEN len(zone_text) <= len(keyword) THEN keyword ELSE zone_text END AS b FROM (SELECT DISTINCT zone_text FROM zone_texts WHERE zone_text <> ''), vocabulary "
        "UNION SELECT DISTINCT zone_text, keyword, keyword, zone_text FROM (SELECT DISTINCT zone_text FROM zone_texts WHERE zone_text <> ''), vocabulary WHERE len(zone_text) = len(keyword)"),
    ("windows", "SELECT DISTINCT zone_text, keyword, a, b[greatest(i, 0) + 1 : i + len(a)] AS w FROM sides, unnest(range(1 - len(a), len(b))) AS t(i)"),
    ("ratios", f"SELECT zone_text, keyword, max(200.0 * l / (len(a) + len(w))) AS score FROM windows JOIN (SELECT a, w, {lcs('a', 'w')} AS l FROM (SELECT DISTINCT a, w FROM windows)) USING (a, w) GROUP BY ALL"),
    ("scored", f"SELECT doc_id, column_id, priority, role, max(score) AS score FROM zone_texts JOIN ratios USING (zone_text) JOIN vocabulary USING (keyword) GROUP BY ALL HAVING max(score) >= {S.fuzzy_threshold}"),
    ("winners", "SELECT doc_id, column_id, arg_min(role, priority) AS role FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, priority ORDER BY score DESC, column_id) AS rn FROM scored) WHERE rn = 1 GROUP BY ALL"),
    ("fuzzy", f"SELECT {ZONE.replace('semantic_role', '').replace('doc_id, column_id', 'z.doc_id, z.column_id')} w.role AS semantic_role FROM zones z LEFT JOIN winners w ON w.doc_id = z.doc_id AND w.column_id = z.column_id"),
    *positional("fallback", "zones"),
    *positional("filled", "fuzzy"),
    ("roles", swapped("filled")),
    *pipeline("merged", "roles"),
    ("files", "SELECT doc_id, max(page_num) + 1 AS total_pages FROM tokens GROUP BY doc_id"),
    ("said", f"SELECT f.doc_id, total_pages, coalesce(m.column_mapping, '') AS column_mapping, coalesce(t.n, 0) AS n_transactions, list_filter([CASE WHEN m.doc_id IS NULL THEN {text('Column detection produced no zones — output may be degraded')} END, CASE WHEN t.doc_id IS NULL THEN 'No transactions reconstructed' END], lambda x: x IS NOT NULL) AS warnings "
        "FROM files f LEFT JOIN mapping m USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM txns GROUP BY doc_id) t USING (doc_id)"),
]


def sql(select: str) -> str:
    """select over the expressions; those that it doesn't need cost nothing."""
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in CTES) + "\n" + select


__all__ = ["NUMBERS", "sql"]
