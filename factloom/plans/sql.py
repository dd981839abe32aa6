"""The same semantics in DuckDB's SQL, for comparison: expressions made from the fixed values, and the ledgers as CTEs."""

from __future__ import annotations

import re

from factloom.functions import vocab as V


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(words: list[str]) -> str:
    return "(" + ", ".join(map(lit, words)) + ")"


def any_of(words: list[str]) -> str:
    return lit("|".join(map(re.escape, words)).replace("\\ ", " ").replace("\\-", "-"))


def case(cases: list[tuple[str, str]], other: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {t} THEN {v}" for t, v in cases) + f" ELSE {other} END"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


HYPHENATED = r"'\b([a-zA-Z]{2,})[%s]\s*\n\s*([a-zA-Z]{2,})\b'"


def clean_text(x: str) -> str:
    plain = f"translate(replace(replace(replace(coalesce({x}, ''), chr(173), ''), chr(8203), ''), chr(65279), ''), chr(160) || chr(8201) || chr(8239), '   ')"
    return rf"regexp_replace({plain}, {HYPHENATED % '-–—'}, '\1\2', 'g')"


def grounding_text(x: str) -> str:
    out = f"coalesce({x}, '')"
    for sign, letters in V.LIGATURES:
        out = f"replace({out}, {lit(sign)}, {lit(letters)})"
    out = f"replace(replace(replace({out}, chr(173), ''), chr(8203), ''), chr(65279), '')"
    out = f"translate({out}, chr(160) || chr(8201) || chr(8239) || '“”’‘`—–−', '   \"\"''''''---')"
    return squeeze(rf"regexp_replace({out}, {HYPHENATED % '-'}, '\1\2', 'g')")


def comparison_text(x: str) -> str:
    out = rf"regexp_replace(lower({x}), '\b(?:rs\.?|inr)\b\.?\s*|[₹$€£]\s*', '₹', 'g')"
    out = rf"regexp_replace({out}, '\bper\s+cent\b|\bpercent\b', '%', 'g')"
    return squeeze(rf"regexp_replace({out}, '(\d)\s+%', '\1%', 'g')")


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, '[a-z0-9%₹]{{2,}}')"


def sentences(x: str) -> str:
    joined = rf"regexp_replace(coalesce({x}, ''), {HYPHENATED % '-–—'}, '\1\2', 'g')"
    paragraphs = rf"regexp_split_to_array({joined}, '\n\s*\n+')"
    one = rf"regexp_replace(regexp_replace(p, '\s*\n\s*', ' ', 'g'), '^\s+|\s+$', '', 'g')"
    # word boundaries are those of letters, not of ASCII letters
    masked = rf"regexp_replace({one}, '(^|[^\p{{L}}\p{{N}}_])({'|'.join(V.ABBREVIATIONS)})\.', '\1\2' || chr(1), 'gi')"
    # no look-behind here: ends of sentences are marked, then split
    parts = rf"string_split(regexp_replace({masked}, '([.?!])\s+', '\1' || chr(2), 'g'), chr(2))"
    return f"list_filter(list_transform(flatten(list_transform({paragraphs}, lambda p: {parts})), lambda s: trim(replace(s, chr(1), '.'))), lambda s: s <> '')"


def title(x: str) -> str:
    return rf"array_to_string(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN i = 1 OR NOT regexp_matches(substr({x}, i - 1, 1), '\p{{L}}') THEN upper(substr({x}, i, 1)) ELSE lower(substr({x}, i, 1)) END), '')"


def word_count(x: str) -> str:
    return rf"len(regexp_extract_all(coalesce({x}, ''), '\S+'))"


def normalize_period(x: str) -> str:
    q, f, c = r"(?:Q([1-4])|([1-4])Q)\s*(?:FY|Fiscal)?\s*(?:20)?(\d{2})", r"(?:FY|Fiscal\s*Year|Fiscal)\s*(?:20)?(\d{2})(?:-(\d{2}))?", r"(?:CY\s*)?(20\d{2})"
    r = r"\b20\d{2}-(\d{2})\b"
    t = f"trim({x})"
    get = lambda p, n: f"regexp_extract({t}, '{p}', {n}, 'i')"
    has = lambda p: f"regexp_matches({t}, '{p}', 'i')"
    return case([
        (f"{x} IS NULL OR {x} = ''", "NULL"), (has(q), f"'Q' || {get(q, 1)} || {get(q, 2)} || ' FY20' || {get(q, 3)}"), (has(r), f"'FY20' || {get(r, 1)}"),
        (has(f), f"'FY20' || coalesce(nullif({get(f, 2)}, ''), {get(f, 1)})"), (has(c), f"'CY' || {get(c, 1)}"),
    ], t)


def sort_key(x: str) -> str:
    t = f"upper(trim({x}))"
    q, f, y = r"Q([1-4])\s*FY(?:20)?(\d{2})", r"FY(?:20)?(\d{2})", r"(?:CY)?(20\d{2})"
    n = f"regexp_extract({t}, '{q}', 1)"
    year = f"CAST(TRY_CAST('20' || regexp_extract({t}, '{q}', 2) AS INTEGER) - CASE WHEN {n} = '4' THEN 0 ELSE 1 END AS VARCHAR)"
    month = case([(f"{n} = '{a}'", f"'{b}'") for a, b in (("1", "06"), ("2", "09"), ("3", "12"), ("4", "03"))])
    return case([
        (f"{x} IS NULL OR {x} = ''", "'9999-99-99'"), (rf"regexp_matches({t}, '^\d{{4}}-\d{{2}}-\d{{2}}')", t), (f"regexp_matches({t}, '{q}')", f"{year} || '-' || {month} || '-Q' || {n}"),
        (f"regexp_matches({t}, '{f}')", f"'20' || regexp_extract({t}, '{f}', 1) || '-04-FY'"), (f"regexp_matches({t}, '{y}')", f"regexp_extract({t}, '{y}', 1) || '-12-CY'"),
    ], f"'9998-' || substr({t}, 1, 10)")


def number(x: str) -> str:
    return rf"TRY_CAST(replace(nullif(regexp_extract(lower(trim({x})), '([\d,]+(?:\.\d+)?)', 1), ''), ',', '') AS DOUBLE)"


def currency(x: str) -> str:
    t = f"lower(trim({x}))"
    return case([(f"contains({t}, {lit(s)})", lit(c)) for s, c in V.CURRENCY_SIGNS] + [(rf"regexp_matches({t}, '\b{w}\b')", lit(c)) for w, c in V.CURRENCY_WORDS])


def multiplier(x: str) -> str:
    # no look-behind here either: the character before is matched instead
    return case([(rf"regexp_matches(lower(trim({x})), '(^|\W|\d){n}\b')", lit(n)) for n, _ in V.MULTIPLIERS])


def factor(name: str) -> str:
    return case([(f"{name} = {lit(n)}", f"{x}::DOUBLE") for n, x in V.MULTIPLIERS], "1.0::DOUBLE")


def technical(x: str) -> str:
    return case([(rf"regexp_matches(lower(trim({x})), '\b{n}\b')", lit(u)) for n, u in V.UNITS])


def percent(x: str) -> str:
    return f"(contains(lower({x}), '%') OR contains(lower({x}), 'percent') OR contains(lower({x}), 'per cent'))"


def value_columns(x: str) -> str:
    """normalized_value, normalized_unit, normalized_currency of a value without unit or currency beside it."""
    n, m = number(x), multiplier(x)
    value = f"CASE WHEN {percent(x)} AND {n} IS NOT NULL THEN {n} ELSE {n} * {factor(m)} END AS normalized_value"
    unit = f"CASE WHEN {percent(x)} AND {n} IS NOT NULL THEN '%' WHEN {n} IS NULL THEN NULL ELSE coalesce({currency(x)}, {technical(x)}, {m}) END AS normalized_unit"
    return f"{value}, {unit}, CASE WHEN {percent(x)} AND {n} IS NOT NULL THEN NULL ELSE {currency(x)} END AS normalized_currency"


def metric_family(x: str) -> str:
    t = f"trim(lower({x}))"
    cases = []
    for k, (family, members) in enumerate(V.METRIC_FAMILIES):
        names = "|".join(m.replace("(", r"\(").replace(")", r"\)") for m in members)
        pattern = names if k < 2 else rf"\b(?:{names})\b"
        cases.append((f"regexp_matches({t}, {lit(pattern)}) OR {t} IN {in_list(members)}", lit(family)))
    return case(cases)


def core_tokens(x: str, stop: list[str]) -> str:
    return rf"list_filter(list_distinct(regexp_extract_all(lower({x}), '\b([a-z]{{2,}})\b', 1)), lambda w: w NOT IN {in_list(stop)})"


def meaningless(x: str) -> str:
    return f"regexp_matches(trim({x}), {lit('^(?:' + '|'.join(V.LONE_NUMBERS) + ')$')}, 'i')"


def quality(subject: str, predicate: str, value: str, evidence: str, period: str, measured: str = "FALSE") -> str:
    s, p, v = f"trim({subject})", f"trim({predicate})", f"trim({value})"
    of_s = case([(rf"{s} = '' OR lower({s}) IN {in_list(V.GENERIC_WORDS)} OR regexp_matches({s}, '^\p{{Ll}}')", "0.0"), (rf"regexp_matches({s}, '^\p{{Lu}}') AND length({s}) >= 3", f"CASE WHEN regexp_matches(lower({s}), {any_of(V.ENTITY_TERMS)}) THEN 1.0 ELSE 0.85 END")], "0.5")
    of_p = case([(f"regexp_matches(lower({p}), {any_of(V.METRIC_KEYWORDS)})", "1.0"), (f"lower({p}) IN {in_list(V.VERB_PREDICATES)}", "0.0"), (f"length({p}) >= 4", "0.7")], "0.5")
    of_v = case([(rf"regexp_matches({v}, '\d')", case([(f"{measured} OR regexp_matches({v}, '[₹$€£%]')", "1.0"), (f"length({v}) > 1 AND NOT {meaningless(v)}", "0.75")], "0.2")), (f"lower({v}) IN {in_list(V.GENERIC_WORDS)}", "0.0")], "0.6")
    of_c = f"(0.5 + CASE WHEN coalesce({period}, '') <> '' THEN 0.3 ELSE 0.0 END + CASE WHEN {measured} THEN 0.2 ELSE 0.0 END)"
    of_e = case([(f"length(trim({evidence})) >= 40", "1.0"), (f"length(trim({evidence})) >= 25", "0.8")], "0.3")
    d = lambda x: f"CAST({x} AS DOUBLE)"
    return f"round({d(of_s)} * 0.3::DOUBLE + {d(of_p)} * 0.3::DOUBLE + {d(of_v)} * 0.2::DOUBLE + {d(of_c)} * 0.1::DOUBLE + {d(of_e)} * 0.1::DOUBLE, 3)"


#: The ledgers: raw facts.
RAW = r"""
home AS (SELECT c_custkey, n_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
placed AS (SELECT o_orderkey, o_totalprice, n_nationkey, n_name, year(o_orderdate) AS y, quarter(o_orderdate) AS q FROM orders JOIN home ON o_custkey = c_custkey),
of_lines AS (
  SELECT n_nationkey, n_name, y, sum(l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2)) * (1 + l_tax::DECIMAL(4,2))) AS v, sum(l_quantity::DECIMAL(12,2)) AS n
  FROM lineitem JOIN placed ON l_orderkey = o_orderkey GROUP BY n_nationkey, n_name, y
),
base AS (
  SELECT 'orders_ledger' AS document_id, '01' AS mon, n_nationkey, n_name, y, 0 AS q, 'revenue' AS predicate, '$' || format('{:,}', CAST(round(sum(o_totalprice::DECIMAL(12,2))) AS BIGINT)) AS value, '' AS lead
  FROM placed GROUP BY n_nationkey, n_name, y
  UNION ALL
  SELECT 'quarter_ledger', '03', n_nationkey, n_name, y, q, 'revenue', '$' || format('{:,}', CAST(round(sum(o_totalprice::DECIMAL(12,2))) AS BIGINT)), 'Q' || CAST(q AS VARCHAR) || ' ' FROM placed GROUP BY n_nationkey, n_name, y, q
  UNION ALL SELECT 'line_ledger', '02', n_nationkey, n_name, y, 0, 'total revenue', '$' || format('{:,}', CAST(round(v) AS BIGINT)), '' FROM of_lines
  UNION ALL SELECT 'volume_ledger', '04', n_nationkey, n_name, y, 0, 'shipments', format('{:,}', CAST(round(n) AS BIGINT)), '' FROM of_lines
  UNION ALL SELECT 'noise_ledger', '05', n_nationkey, n_name, 1995, 0, 'increased', CAST(n_nationkey AS VARCHAR), '' FROM nation
),
dated AS (SELECT *, lead || 'FY' || lpad(CAST((y + 24) % 100 AS VARCHAR), 2, '0') AS period FROM base),
raw AS (
  SELECT sha256(concat_ws(chr(1), document_id, CAST(n_nationkey AS VARCHAR), period, n_name, predicate, value)) AS id, document_id, document_id || '.pdf' AS filename, CAST(n_nationkey + 1 AS INTEGER) AS page_number,
         n_nationkey, n_name AS subject, predicate, value, 'financial_metric' AS fact_type, period,
         CASE WHEN document_id = 'orders_ledger' AND n_nationkey % 3 = 0 THEN 'consolidated' WHEN document_id = 'line_ledger' AND n_nationkey % 6 = 0 THEN 'standalone' END AS scope,
         n_name || ' reported ' || predicate || ' of ' || value || ' in ' || period || '.' AS evidence_quote,
         '2024-' || mon || '-' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') || 'T00:' || lpad(CAST((y + 24) % 100 AS VARCHAR), 2, '0') || ':' || lpad(CAST(q AS VARCHAR), 2, '0') || '+00:00' AS created_at
  FROM dated
),
paged AS (
  SELECT *, CASE WHEN n_nationkey % 4 < 2 THEN 'Annual note. ' || evidence_quote || ' All figures are audited.'
                 WHEN n_nationkey % 8 = 2 THEN 'In ' || period || ' came ' || value || ' of ' || predicate || ', as ' || subject || ' posted.'
                 WHEN n_nationkey % 8 = 6 THEN CASE WHEN document_id = 'volume_ledger' THEN 'In ' ELSE 'During ' END || period || ' came ' || value || ', near ' || predicate || ', as ' || subject || ' posted.'
                 ELSE 'No figures were published for ' || subject || '.' END AS page_text
  FROM raw
)"""


def overlap(evidence: str, page: str) -> str:
    words = rf"regexp_extract_all({squeeze(f'lower({evidence})')}, '\w{{3,}}')"
    return f"(len(list_filter({words}, lambda w: contains({squeeze(f'lower({page})')}, w)))::DOUBLE / len({words}))"


def reason(s: str, p: str, v: str, e: str, q: str, page: str) -> str:
    """The gates in their order. Parts that no row here can meet (kept lower-case names) are left to the tests."""
    ls, lp, lv = f"lower({s})", f"lower({p})", f"lower({v})"
    gates = [
        (f"{s} = ''", "'Missing subject / entity'"), (f"length({s}) < 2", f"'Subject is too short or ambiguous: ''' || {s} || ''''"), (f"{p} = ''", "'Missing predicate / metric'"),
        (f"length({p}) < 2", f"'Predicate is too short or ambiguous: ''' || {p} || ''''"), (f"{v} = ''", "'Missing fact value'"),
        (meaningless(v), f"'Meaningless number: value ''' || {v} || ''' is an isolated digit or footnote marker without an associated metric'"),
        (f"{e} = ''", "'Missing evidence quote'"), (f"length({e}) < 15", f"'Evidence quote is too brief to substantiate a claim: ''' || {e} || ''''"),
        (f"{ls} IN {in_list(V.GENERIC_WORDS)}", f"'Subject ''' || {s} || ''' is a generic verb, pronoun, or preposition, not an entity'"),
        (rf"regexp_matches({s}, '^\p{{Ll}}')", f"'Subject ''' || {s} || ''' starts with a lowercase letter, indicating an arbitrary sentence fragment'"),
        *[(f"ends_with({ls}, {lit(' ' + x)})", f"'Subject ''' || {s} || ''' ends with dangling connector ''{x}'', indicating a broken fragment'") for x in V.FRAGMENT_ENDINGS],
        *[(f"starts_with({ls}, {lit(x)})", f"'Subject ''' || {s} || ''' begins with clause connector ''{x.strip()}'', indicating a broken fragment'") for x in V.FRAGMENT_PREFIXES],
        (rf"regexp_matches({s}, '^[0-9\W_]+$')", f"'Subject ''' || {s} || ''' contains no valid entity characters'"),
        (f"{lp} IN {in_list(V.VERB_PREDICATES + V.GENERIC_WORDS)}", f"'Predicate ''' || {p} || ''' is a generic verb or word without an associated metric name'"),
        (rf"regexp_matches({p}, '^\d+$') OR regexp_matches({p}, '^(?:(?:FY|CY|Q[1-4])\s*\d{{2,4}}[\s,/–-]*)+$', 'i')", f"'Predicate ''' || {p} || ''' is purely a number or period, not a metric'"),
        (f"{lv} IN {in_list(V.GENERIC_WORDS + V.VERB_PREDICATES)}", f"'Value ''' || {v} || ''' is a generic action word rather than a metric quantity or state'"),
        (f"{ls} = {lp}", f"'Subject and predicate are identical (''' || {s} || '''), which does not form a meaningful claim'"),
        (f"{lp} = {lv}", f"'Predicate and value are identical (''' || {p} || '''), indicating a redundant extraction fragment'"),
        (f"{q} < 0.60", f"'Fact quality score ' || format('{{:.2f}}', {q}) || ' is below minimum threshold (0.60)'"),
        (f"{overlap(e, page)} < 0.35", "'Evidence quote does not sufficiently overlap with source chunk text'"),
    ]
    return case(gates)


JUDGED = f"""
scored AS (SELECT *, {quality("subject", "predicate", "value", "evidence_quote", "period")} AS quality_score FROM paged),
judged AS (SELECT *, {reason("subject", "predicate", "value", "evidence_quote", "quality_score", "page_text")} AS rejection_reason FROM scored)"""

GROUNDED = f"""
g1 AS (SELECT *, {grounding_text("evidence_quote")} AS q, {grounding_text("page_text")} AS p FROM judged WHERE rejection_reason IS NULL),
g2 AS (SELECT *, {comparison_text("q")} AS qc, {comparison_text("p")} AS pc FROM g1),
g3 AS (SELECT *, {tokens("qc")} AS qt, {tokens("pc")} AS pt FROM g2),
g4 AS (
  SELECT *, CASE WHEN q = '' OR p = '' THEN 0.0 WHEN contains(lower(p), lower(q)) OR contains(pc, qc) THEN 1.0 WHEN len(qt) = 0 OR len(pt) = 0 THEN 0.0
                 WHEN contains(array_to_string(pt, ' '), array_to_string(qt, ' ')) THEN 1.0 END::DOUBLE AS exact,
         len(list_intersect(list_distinct(qt), list_distinct(pt)))::DOUBLE / len(list_distinct(qt)) AS share
  FROM g3
),
g5 AS (SELECT *, coalesce(exact, round(CAST(least(1.0::DOUBLE, CASE WHEN share > 0.8 THEN share * 0.95::DOUBLE WHEN share > 0.6 THEN share * 0.85::DOUBLE ELSE 0.0::DOUBLE END) AS VARCHAR)::DECIMAL(18, 17), 4)::DOUBLE) AS grounding_score FROM g4),
accepted AS (
  SELECT id, document_id, filename, page_number, subject, predicate, value, fact_type, {normalize_period("period")} AS period, scope, evidence_quote, quality_score, grounding_score,
         CASE WHEN grounding_score >= 0.85 THEN 'VERIFIED' WHEN grounding_score >= 0.60 THEN 'PARTIAL' ELSE 'UNVERIFIED' END AS grounding_status,
         round(least(0.98::DOUBLE, greatest(0.2::DOUBLE, grounding_score * 0.55::DOUBLE + quality_score * 0.45::DOUBLE)), 3) AS confidence, {value_columns("value")},
         'ACCEPTED' AS status, CAST(NULL AS VARCHAR) AS rejection_reason, created_at
  FROM g5
),
facts AS (
  SELECT id, document_id, filename, page_number, subject, predicate, value, fact_type, period, scope, normalized_currency AS currency, evidence_quote, quality_score, grounding_score, grounding_status, confidence,
         normalized_value, normalized_unit, status, rejection_reason, created_at FROM accepted
  UNION ALL
  SELECT id, document_id, filename, page_number, subject, predicate, value, fact_type, period, scope, NULL, evidence_quote, quality_score, 0.0, 'UNVERIFIED', 0.1, NULL, NULL, 'REJECTED', rejection_reason, created_at
  FROM judged WHERE rejection_reason IS NOT NULL
)"""

DOCS = "\n, docs AS (\n" + "\nUNION ALL\n".join(
    f"SELECT '{doc}' AS id, '{doc}.pdf' AS filename, sha256('{source}') AS file_hash, count(*) AS file_size, '{'FAILED' if doc == 'failed_ledger' else 'COMPLETED'}' AS status, "
    f"{lit('unreadable file') if doc == 'failed_ledger' else 'CAST(NULL AS VARCHAR)'} AS error_message, '2024-{month}-01T00:00:00+00:00' AS created_at FROM {source}"
    for doc, source, month in (("orders_ledger", "orders", "01"), ("line_ledger", "lineitem", "02"), ("quarter_ledger", "orders", "03"), ("volume_ledger", "lineitem", "04"), ("noise_ledger", "nation", "05"), ("failed_ledger", "region", "06"))
) + ")"

FACTS = "WITH " + RAW + "," + JUDGED + "," + GROUNDED

#: Subjects here have no core tokens (their names are one word with a digit), so only equal ones score.
PAIRS = (
    FACTS
    + f""",
scored_pairs AS (
  SELECT a.id AS a_id, b.id AS b_id, a.subject AS a_subject, b.subject AS b_subject, a.predicate AS a_predicate, b.predicate AS b_predicate, a.period AS a_period, b.period AS b_period, a.scope AS a_scope, b.scope AS b_scope,
         a.value AS a_value, b.value AS b_value, a.normalized_value AS a_v, b.normalized_value AS b_v, a.normalized_unit AS a_u, b.normalized_unit AS b_u, a.filename AS a_filename, b.filename AS b_filename,
         a.document_id AS a_document_id, b.document_id AS b_document_id, a.page_number AS a_page, b.page_number AS b_page, a.evidence_quote AS a_evidence, b.evidence_quote AS b_evidence,
         a.grounding_score AS a_g, b.grounding_score AS b_g, a.created_at AS a_created_at, b.created_at AS b_created_at,
         {metric_family("a.predicate")} AS fa, {metric_family("b.predicate")} AS fb,
         CASE WHEN a.period = b.period THEN 1.0 WHEN {" OR ".join(f"(contains(a.period, '{y}') AND contains(b.period, '{y}'))" for y in V.SAME_YEARS)} THEN 0.8 ELSE 0.6 END::DOUBLE AS when_score
  FROM facts a JOIN facts b ON lower(trim(a.subject)) = lower(trim(b.subject)) AND a.document_id <> b.document_id AND a.id < b.id AND a.status = 'ACCEPTED' AND b.status = 'ACCEPTED'
),
pairs AS (
  SELECT *, round(1.0::DOUBLE * 0.5 + 1.0::DOUBLE * 0.35 + when_score * 0.15, 4) AS match_score,
         'subject alignment (''' || a_subject || ''' ~ ''' || b_subject || ''') + metric alignment (''' || a_predicate || ''' ~ ''' || b_predicate || ''') + ' ||
         CASE WHEN when_score = 1.0 THEN 'identical period (' || a_period || ')' WHEN when_score = 0.8 THEN 'overlapping fiscal timeframe (' || a_period || ' vs ' || b_period || ')'
              ELSE 'comparable reporting periods (' || a_period || ' vs ' || b_period || ')' END AS match_reason
  FROM scored_pairs WHERE fa = fb AND 0.5 + 0.35 + when_score * 0.15 >= 0.70
)"""
)

RELATIONS = (
    PAIRS
    + """,
compared AS (
  SELECT *, CASE WHEN a_v = 0 THEN b_v = 0 ELSE abs(a_v - b_v) / abs(a_v) < 0.015 AND NOT coalesce(a_u <> b_u, FALSE) END AS same,
         coalesce(a_period <> b_period, FALSE) AS dp, coalesce(a_scope <> b_scope, FALSE) AS ds, coalesce(a_u <> b_u, FALSE) AS du,
         least(0.98::DOUBLE, greatest(0.5::DOUBLE, sqrt(0.85::DOUBLE * 0.85::DOUBLE * a_g * b_g))) AS c0
  FROM pairs
),
classified AS (
  SELECT *, CASE WHEN same AND NOT dp AND NOT ds AND NOT du THEN 'CORROBORATE' WHEN dp OR ds OR du THEN 'RECONCILE' WHEN NOT same AND a_period = b_period THEN 'CONTRADICT' ELSE 'UNRELATED' END AS type,
         least(a_id, b_id) || '__' || greatest(a_id, b_id) AS canonical_key, greatest(a_created_at, b_created_at) AS created_at
  FROM compared
),
relationships AS (
  SELECT *, sha256(canonical_key) AS id,
         round(c0 * CASE WHEN type = 'CORROBORATE' THEN 0.98 WHEN dp THEN 0.94 WHEN ds THEN 0.92 WHEN du THEN 0.90 ELSE 0.92 END::DOUBLE, 3) AS confidence,
         CASE WHEN type = 'CORROBORATE' THEN 'Both documents (' || a_filename || ' and ' || b_filename || ') independently corroborate ' || a_subject || '''s ' || a_predicate || ' of ' || a_value || ' for ' || a_period || coalesce(' (' || a_scope || ')', '') || '.'
              WHEN dp AND (contains(lower(a_period), 'q') <> contains(lower(b_period), 'q')) THEN 'Apparent contradiction reconciled: ''' || a_filename || ''' reports for quarterly period ' || a_period || ' (' || a_value || ') while ''' || b_filename || ''' reports for full-year ' || b_period || ' (' || b_value || ').'
              WHEN dp THEN 'Apparent numerical variance reconciled: reported values represent different fiscal time horizons (' || a_period || ' with ' || a_value || ' vs ' || b_period || ' with ' || b_value || ').'
              WHEN ds THEN 'Reported values for ' || a_predicate || ' differ due to reporting scope: ''' || a_filename || ''' reports ' || a_scope || ' (' || a_value || ') whereas ''' || b_filename || ''' reports ' || b_scope || ' (' || b_value || ').'
              WHEN du THEN 'Both documents measure ' || a_predicate || ', but report in different unit/currency scales (' || coalesce(a_u, a_value) || ' vs ' || coalesce(b_u, b_value) || ').'
              ELSE 'Direct contradiction detected for ' || a_subject || ' - ' || a_predicate || ' for ' || a_period || ': ''' || a_filename || ''' reports ' || a_value || ' whereas ''' || b_filename || ''' reports ' || b_value || '. With matching reporting periods and scopes, these figures represent genuinely conflicting claims.' END AS reasoning
  FROM classified WHERE type <> 'UNRELATED'
)"""
)

_KEY = "sha256(concat_ws(chr(1), '=' || lower(trim(subject)), '=' || lower(trim(predicate)), coalesce('=' || upper(nullif(period, '')), '-'), coalesce('=' || lower(nullif(scope, '')), '-')))"
CLUSTERS = (
    FACTS
    + f""",
members AS (SELECT DISTINCT {_KEY} AS cluster_id, id AS fact_id, created_at AS added_at FROM facts WHERE status = 'ACCEPTED'),
grouped AS (
  SELECT m.cluster_id AS id, min(lower(trim(f.subject))) AS low_subject,
         min(lower(trim(f.predicate))) AS low_predicate, min(upper(nullif(f.period, ''))) AS canonical_period, min(lower(nullif(f.scope, ''))) AS canonical_scope,
         count(DISTINCT f.id) AS fact_count, count(DISTINCT f.document_id) AS source_doc_count, min(f.created_at) AS created_at, max(f.created_at) AS updated_at
  FROM members m JOIN facts f ON m.fact_id = f.id GROUP BY m.cluster_id
),
clusters AS (
  SELECT *, {title("low_subject")} AS canonical_subject, {title("low_predicate")} AS canonical_predicate FROM grouped
)"""
)
