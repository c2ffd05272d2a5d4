r"""Expected results as DuckDB SQL over the same tables.

RE2's ``\s`` and ``\b`` are ASCII only, so whitespace is spelled out; the
documents hold no phone numbers, government ids or street addresses, hence only
the e-mail and card patterns appear here.
"""

from __future__ import annotations

from tamis import fixed

SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
CARD = r"\b\d{13,19}\b"


def tokens(text: str) -> str:
    return f"len(list_filter(regexp_split_to_array({text}, '{SPACE}'), lambda t: t <> ''))"


def ratio(text: str) -> str:
    return (
        f"CASE WHEN length({text}) = 0 THEN 0.0 ELSE length(regexp_replace({text}, "
        rf"'[\p{{L}}\p{{N}}]+', '', 'g'))::DOUBLE / length({text}) END"
    )


def words(text: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+'))"


def luhn(number: str) -> str:
    digit = f"CAST(substr({number}, length({number}) - p, 1) AS INTEGER)"
    doubled = f"CASE WHEN {digit} > 4 THEN {digit} * 2 - 9 ELSE {digit} * 2 END"
    return (
        f"list_sum(list_transform(range(length({number})), lambda p: "
        f"CASE WHEN p % 2 = 1 THEN {doubled} ELSE {digit} END)) % 10 = 0"
    )


def spans(pattern: str, category: str) -> str:
    """Spans of one pattern over documents: gaps and matches alternate."""
    return f"""
        SELECT doc_id, hit, '{category}' AS pii_category, first AS span_start,
               first + length(hit) AS span_end
        FROM (
            SELECT doc_id, hits[k] AS hit,
                   CAST(coalesce(list_sum(list_transform(gaps[1:k], lambda g: length(g))), 0)
                   + coalesce(list_sum(list_transform(hits[1:k-1], lambda h: length(h))), 0)
                   AS INTEGER) AS first
            FROM (
                SELECT doc_id, regexp_extract_all(text, '{pattern}') AS hits,
                       regexp_split_to_array(text, '{pattern}') AS gaps
                FROM documents
            ), LATERAL (SELECT unnest(range(1, len(hits) + 1)) AS k)
        )"""


PII = f"""
    email AS ({spans(EMAIL, "email")}),
    card AS (SELECT * FROM ({spans(CARD, "credit_card")}) WHERE {luhn("hit")}),
    pii AS (
        SELECT * FROM email UNION ALL
        SELECT c.* FROM card c WHERE NOT EXISTS (
            SELECT 1 FROM email e WHERE e.doc_id = c.doc_id
            AND e.span_start <= c.span_start AND c.span_start < e.span_end)
    )"""

INDEX = "idx AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)"


def exact(table: str, key: str, content: str) -> str:
    return f"""
        SELECT rec_ord, first_ord, i, min(i) OVER (PARTITION BY {content}) AS first_i FROM (
            SELECT *, {key} AS rec_ord, min({key}) OVER (PARTITION BY {content}) AS first_ord,
                   row_number() OVER (ORDER BY {key}) - 1 AS i FROM {table})
        QUALIFY rec_ord <> first_ord"""


def exact_issues(table: str, key: str, content: str) -> str:
    return f"""
        SELECT rec_ord, 'duplicate' AS category, NULL::VARCHAR AS field_name,
               printf('{fixed.DETAIL_DUPLICATE}', i, first_i) AS detail, NULL::DOUBLE AS score
        FROM ({exact(table, key, content)})"""


def near_issues(table: str, key: str, content: str, text: str, threshold: float) -> str:
    return f"""
        WITH t AS (SELECT *, {key} AS rec_ord, row_number() OVER (ORDER BY {key}) - 1 AS i,
                          {text} AS body FROM {table}),
        f AS (SELECT {content}, min(rec_ord) AS first_ord, min(i) AS first_i,
                     {words("any_value(body)")} AS ws FROM t GROUP BY {content}),
        p AS (SELECT a.first_ord AS rec_ord, a.first_i AS i, b.first_ord AS other_first,
                     len(list_intersect(a.ws, b.ws)) AS shared, len(a.ws) + len(b.ws) AS total
              FROM f a JOIN f b ON a.first_ord > b.first_ord
              AND least(len(a.ws), len(b.ws)) >= {threshold} * greatest(len(a.ws), len(b.ws)) - 1e-9
              AND len(a.ws) > 0 AND len(b.ws) > 0),
        s AS (SELECT *, shared::DOUBLE / (total - shared) AS score FROM p),
        member AS (SELECT rec_ord AS other_ord, i AS other_i,
                          min(rec_ord) OVER (PARTITION BY {content}) AS other_first FROM t)
        SELECT s.rec_ord, 'near_duplicate' AS category, NULL::VARCHAR AS field_name,
               printf('{fixed.DETAIL_NEAR_DUPLICATE}', s.i, m.other_i,
                      format('{{:.3f}}', score), '{threshold:.3f}') AS detail, score
        FROM s JOIN member m ON m.other_first = s.other_first AND m.other_ord < s.rec_ord
        WHERE score >= {threshold}"""


def quality(table: str, text: str, short: int = 3, gibberish: float = 0.5, empty: str = "") -> str:
    source = f"(SELECT *, {text} AS body FROM {table})"
    empty = empty or "NOT regexp_matches(body, '[^\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]')"
    return f"""
        SELECT doc_id AS rec_ord, 'low_quality_short' AS category, NULL::VARCHAR AS field_name,
               printf('{fixed.DETAIL_SHORT}', n, {short}) AS detail, n::DOUBLE AS score
        FROM (SELECT doc_id, {tokens("body")} AS n FROM {source}) WHERE n < {short}
        UNION ALL
        SELECT doc_id, 'low_quality_gibberish', NULL,
               printf('{fixed.DETAIL_GIBBERISH}', format('{{:.3f}}', r), '{gibberish}'), r
        FROM (SELECT doc_id, {ratio("body")} AS r FROM {source}) WHERE r >= {gibberish}
        UNION ALL
        SELECT doc_id, 'empty_record', NULL, '{fixed.DETAIL_EMPTY}', NULL
        FROM {source} WHERE {empty}"""


PII_ISSUES = """
        SELECT doc_id AS rec_ord, 'pii' AS category, 'text' AS field_name,
               pii_category || ' detected in field ''text''' AS detail, NULL::DOUBLE AS score
        FROM pii"""

# All issues of a default analysis of the documents.
ISSUES = f"""WITH {PII}, issues AS (
    SELECT * FROM ({exact_issues("documents", "doc_id", "text")})
    UNION ALL SELECT * FROM ({near_issues("documents", "doc_id", "text", "text", 0.9)})
    UNION ALL SELECT * FROM ({PII_ISSUES})
    UNION ALL SELECT * FROM ({quality("documents", "text")})
), category AS (
    SELECT unnest(range(13))::INTEGER AS category_ord,
           unnest({list(fixed.ISSUE_CATEGORIES)}) AS category
), counts AS (
    SELECT category_ord, c.category, count(i.category) AS n_issues
    FROM category c LEFT JOIN issues i USING (category) GROUP BY ALL
), stats AS (
    SELECT count(*) AS record_count, CAST(round_even(avg(n), 0) AS BIGINT) AS mean_tokens,
           CAST(min(n) AS BIGINT) AS min_tokens, CAST(max(n) AS BIGINT) AS max_tokens
    FROM (SELECT {tokens("text")} AS n FROM documents)
), metrics AS (
    SELECT *, (SELECT count(DISTINCT rec_ord) FROM issues)::DOUBLE / record_count
              AS issue_record_proportion FROM stats
)"""

LABELLED = "(SELECT d.doc_id, text, lang, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id))"
LABELLED_TEXT = "concat_ws(' ', text, lang, quality, toxic)"
TOXIC = f"""
        SELECT doc_id AS rec_ord,
               CASE WHEN toxic IS NULL THEN 'analysis_failure' ELSE 'toxicity' END AS category,
               NULL::VARCHAR AS field_name,
               CASE WHEN toxic IS NULL THEN '{fixed.DETAIL_UNSCORED}'
               ELSE printf('{fixed.DETAIL_TOXICITY}', '1.000', '0.500') END AS detail,
               toxic::DOUBLE AS score
        FROM {LABELLED} WHERE toxic IS NULL OR toxic >= 0.5"""

_MISSING = fixed.DETAIL_MISSING.replace("'", "''")
_MISMATCH = fixed.DETAIL_MISMATCH.replace("'", "''")


def missing(table: str, key: str, name: str, reason: str, where: str) -> str:
    return f"""
        SELECT {key} AS rec_ord, 'missing_required_field' AS category, '{name}' AS field_name,
               printf('{_MISSING}', '{name}', '{reason}') AS detail, NULL::DOUBLE AS score
        FROM {table} WHERE {where}"""


def mismatch(table: str, key: str, name: str, actual: str, expected: str, where: str) -> str:
    return f"""
        SELECT {key} AS rec_ord, 'field_type_mismatch' AS category, '{name}' AS field_name,
               printf('{_MISMATCH}', '{name}', '{actual}', '{expected}') AS detail,
               NULL::DOUBLE AS score
        FROM {table} WHERE {where}"""


LABELLED_FIELDS = (
    ("text", "string"), ("lang", "string"), ("quality", "integer"), ("toxic", "integer"),
)


def first_type(name: str, kind: str) -> str:
    """Type of a field in the first document, which need not have labels."""
    return f"""(SELECT CASE WHEN {name} IS NULL THEN 'null' ELSE '{kind}' END
        FROM {LABELLED} ORDER BY doc_id LIMIT 1)"""


def inferred_issues(name: str, kind: str) -> str:
    expected = first_type(name, kind)
    return f"""
        SELECT doc_id AS rec_ord, CASE WHEN {name} IS NULL THEN 'missing_required_field'
               ELSE 'field_type_mismatch' END AS category, '{name}' AS field_name,
               CASE WHEN {name} IS NULL THEN printf('{_MISSING}', '{name}', 'null')
               ELSE printf('{_MISMATCH}', '{name}', '{kind}', {expected}) END AS detail,
               NULL::DOUBLE AS score
        FROM {LABELLED} WHERE doc_id > (SELECT min(doc_id) FROM documents)
        AND ({name} IS NULL OR {expected} = 'null')"""


ORACLE_SQL = {
    "token_counts": f"SELECT doc_id, {tokens('text')} AS tokens FROM documents",
    "token_metrics": f"{ISSUES} SELECT * FROM stats",
    "word_set_sizes": f"SELECT doc_id, len({words('text')}) AS words FROM documents",
    "record_text": """
        SELECT event_id AS rec_ord, concat_ws(' ', event_id, user_id, event_type,
               CAST(value AS VARCHAR), props) AS text,
               concat_ws(' ', event_type, props) AS string_text FROM events""",
    "non_alnum_ratios": f"""
        SELECT doc_id, ratio, format('{{:.3f}}', ratio) AS shown
        FROM (SELECT doc_id, {ratio('text')} AS ratio FROM documents)""",
    "number_text": "SELECT o_orderkey, CAST(o_totalprice AS VARCHAR) AS text FROM orders",
    "field_type_profile": f"""
        SELECT 'text' AS name, CASE WHEN text IS NULL THEN 'null' ELSE 'string' END AS type,
               count(*) AS n FROM {LABELLED} GROUP BY 2
        UNION ALL SELECT 'lang', CASE WHEN lang IS NULL THEN 'null' ELSE 'string' END, count(*)
        FROM {LABELLED} GROUP BY 2
        UNION ALL SELECT 'quality', CASE WHEN quality IS NULL THEN 'null' ELSE 'integer' END,
               count(*) FROM {LABELLED} GROUP BY 2
        UNION ALL SELECT 'toxic', CASE WHEN toxic IS NULL THEN 'null' ELSE 'integer' END,
               count(*) FROM {LABELLED} GROUP BY 2""",
    "blank_fields": f"""
        SELECT doc_id AS rec_ord, trim(text) = '' AS text_blank, quality IS NULL AS quality_blank,
               trim(text) = '' AND trim(lang) = '' AND quality IS NULL AND toxic IS NULL
               AS all_blank FROM {LABELLED}""",
    "quality_issues": quality("documents", "text"),
    "quality_short": f"SELECT * FROM ({quality('documents', 'text', 50)}) "
    "WHERE category = 'low_quality_short'",
    "quality_gibberish": f"SELECT * FROM ({quality('documents', 'text', 3, 0.2)}) "
    "WHERE category = 'low_quality_gibberish'",
    "quality_empty": f"""SELECT * FROM
        ({quality(LABELLED, LABELLED_TEXT, empty="quality IS NULL")})
        WHERE category = 'empty_record'""",
    "pii_spans": f"""WITH {PII}
        SELECT doc_id, 'text' AS field_name, pii_category, span_start, span_end,
               pii_category || ' detected in field ''text''' AS detail FROM pii""",
    "pii_contacts": """WITH letter AS (
            SELECT c_custkey, c_custkey % 7 < 6 AS street,
                28 + length((c_custkey % 100000)::VARCHAR) + length(c_mktsegment) + 2
                + length(['Street', 'Avenue', 'Road', 'Boulevard', 'Lane', 'Drive', 'Place'][c_custkey % 7 + 1]) AS stop
            FROM customer)
        SELECT c_custkey, 'phone' AS pii_category, 5 AS span_start, 17 AS span_end FROM letter
        UNION ALL SELECT c_custkey, 'physical_address', 28, stop FROM letter WHERE street
        UNION ALL SELECT c_custkey, 'government_id', stop + 25, stop + 36 FROM letter""",
    "pii_counts": f"""WITH {PII} SELECT pii_category, count(*) AS n_spans,
        count(DISTINCT doc_id) AS n_records FROM pii GROUP BY 1""",
    # Cards shadowed by an e-mail do not occur outside e-mails, so replacing
    # e-mails first and valid cards after gives the same text.
    "redacted_documents": f"""WITH {PII},
        cut AS (SELECT doc_id, pii_category, span_start, span_end,
                lag(span_end, 1, 0) OVER (PARTITION BY doc_id ORDER BY span_start) AS free_from,
                row_number() OVER (PARTITION BY doc_id ORDER BY span_start DESC) AS from_end
                FROM pii),
        piece AS (SELECT doc_id, string_agg(
                    substr(text, free_from + 1, span_start - free_from) || '['
                    || upper(pii_category) || ']', '' ORDER BY span_start)
                  || any_value(substr(text, span_end + 1)) FILTER (from_end = 1) AS text
                  FROM cut JOIN documents USING (doc_id) GROUP BY doc_id)
        SELECT d.doc_id, coalesce(p.text, d.text) AS text
        FROM documents d LEFT JOIN piece p USING (doc_id)""",
    "luhn_check": f"""SELECT o_orderkey, {luhn('number')} AS valid FROM (
        SELECT o_orderkey, lpad(o_custkey::VARCHAR, 8, '0') || lpad(o_orderkey::VARCHAR, 8, '0')
        AS number FROM orders)""",
    "toxicity_flags": TOXIC,
    "toxicity_scores": f"""SELECT doc_id, greatest(0.0, least(1.0, 1.5 - r * 5)) AS score
        FROM (SELECT doc_id, CAST({ratio('text')} AS DOUBLE) AS r FROM documents)""",
    "toxicity_bad_threshold": """SELECT NULL::BIGINT AS rec_ord, 'config_error' AS category,
        'toxicity_threshold' AS field_name, 'Invalid configuration for ''toxicity_threshold'': 1.5; retaining default 0.8'
        AS detail, NULL::DOUBLE AS score FROM documents""",
    "exact_duplicates": exact_issues("documents", "doc_id", "text"),
    "exact_duplicate_labels": exact_issues("labels", "doc_id", "quality, toxic"),
    "first_occurrences": "SELECT min(doc_id) AS first_ord, count(*) AS n_records "
    "FROM documents GROUP BY text",
    "repeated_orders": f"""SELECT rec_ord, first_ord FROM
        ({exact("orders", "o_orderkey", "o_orderstatus, o_orderpriority")})""",
    "near_duplicates": near_issues("documents", "doc_id", "text", "text", 0.9),
    "near_duplicates_low": near_issues("documents", "doc_id", "text", "text", 0.6),
    "near_duplicate_turns": near_issues(
        "conversations", "(conv_id * (SELECT max(turn) + 1 FROM conversations) + turn)", "role, text",
        "concat_ws(' ', role, text)", 0.3,
    ),
    "duplicate_issues": f"""
        SELECT * FROM ({exact_issues("documents", "doc_id", "text")})
        UNION ALL SELECT * FROM ({near_issues("documents", "doc_id", "text", "text", 0.9)})
        UNION ALL SELECT NULL, 'config_error', 'similarity_threshold',
        'Invalid configuration for ''similarity_threshold'': 7; retaining default 0.9', NULL""",
    "schema_declared": " UNION ALL ".join(
        [
            mismatch("events", "event_id", "ts", "object", "string", "ts IS NOT NULL"),
            missing("events", "event_id", "ts", "null", "ts IS NULL"),
            mismatch("events", "event_id", "value", "float", "integer", "value IS NOT NULL"),
            missing("events", "event_id", "value", "null", "value IS NULL"),
            missing("events", "event_id", "event_type", "null", "event_type IS NULL"),
            mismatch("events", "event_id", "props", "string", "object", "props IS NOT NULL"),
            missing("events", "event_id", "session", "absent", "true"),
        ]
    ),
    "schema_inferred": " UNION ALL ".join(
        inferred_issues(name, kind) for name, kind in LABELLED_FIELDS
    ),
    "inferred_fields": " UNION ALL ".join(
        f"""SELECT {i} AS ord, '{name}' AS name, {first_type(name, kind)} AS type, true AS required,
            (SELECT count(*) FROM {LABELLED} WHERE ({name} IS NULL) =
             ({first_type(name, kind)} = 'null')) AS n"""
        for i, (name, kind) in enumerate(LABELLED_FIELDS)
    ),
    "issue_category_counts": f"{ISSUES} SELECT category_ord, category, n_issues FROM counts",
    "path_category_counts": f"{ISSUES} SELECT category_ord, category, n_issues FROM counts",
    "extra_detector_records": f"""{ISSUES} SELECT rec_ord AS doc_id FROM issues
        UNION SELECT doc_id FROM documents WHERE length(coalesce(text, '')) % 5 = 0""",
    "quality_metrics": f"{ISSUES} SELECT *, 1 - issue_record_proportion AS quality_score FROM metrics",
    "issue_records": f"{ISSUES} SELECT DISTINCT rec_ord AS doc_id FROM issues",
    "report_totals": f"""{ISSUES} SELECT (SELECT count(*) FROM documents) AS total_records,
        (SELECT count(*) FROM issues) AS total_issues""",
    "all_issues": f"""WITH {PII}
        SELECT rec_ord, category, field_name, NULL AS pii_category, detail, 1 AS stage
        FROM ({exact_issues(LABELLED, "doc_id", "text, lang, quality, toxic")})
        UNION ALL SELECT rec_ord, category, field_name, NULL, detail, 1 FROM
        ({near_issues(LABELLED, "doc_id", "text, lang, quality, toxic", LABELLED_TEXT, 0.9)})
        UNION ALL SELECT doc_id, 'pii', 'text', pii_category,
        pii_category || ' detected in field ''text''', 2 FROM pii
        UNION ALL SELECT rec_ord, category, field_name, NULL, detail, 2 FROM ({TOXIC})
        UNION ALL SELECT rec_ord, category, field_name, NULL, detail, 2
        FROM ({quality(LABELLED, LABELLED_TEXT, empty="trim(text) = '' AND trim(lang) = '' AND quality IS NULL")})
        UNION ALL SELECT rec_ord, category, field_name, NULL, detail, 3
        FROM ({missing(LABELLED, "doc_id", "quality", "null", "quality IS NULL")})
        UNION ALL SELECT rec_ord, category, field_name, NULL, detail, 3
        FROM ({mismatch(LABELLED, "doc_id", "lang", "string", "list", "lang IS NOT NULL")})""",
    "report_markdown_lines": f"""{ISSUES}, head AS (
        SELECT unnest(range(16))::INTEGER AS place, unnest(['{fixed.MD_TITLE}', '', '{fixed.MD_SUMMARY}',
            '- Total records: ' || record_count, '- Total issues: ' || (SELECT count(*) FROM issues),
            '', '{fixed.MD_METRICS}', '- record_count: ' || record_count,
            '- mean_tokens: ' || mean_tokens, '- min_tokens: ' || min_tokens,
            '- max_tokens: ' || max_tokens, '- issue_record_proportion: ' || issue_record_proportion,
            '- quality_score: ' || (1 - issue_record_proportion), '', '{fixed.MD_CATEGORIES}'])
            AS line FROM metrics)
        SELECT -1 AS category_ord, place, NULL::BIGINT AS rec_ord, line FROM head WHERE line IS NOT NULL
        UNION ALL SELECT category_ord, 0, NULL, '### ' || category || ' (count: ' || n_issues || ')'
        FROM counts
        UNION ALL SELECT category_ord, 1, NULL, '{fixed.MD_NO_ISSUES}' FROM counts WHERE n_issues = 0
        UNION ALL SELECT category_ord, 3, NULL, '' FROM counts WHERE category_ord < 12
        UNION ALL SELECT category_ord, 2, rec_ord, '- ' || detail FROM issues JOIN category USING (category)""",
    "report_json_issues": f"""
        SELECT rec_ord, '{{"category":"low_quality_short","location":{{"source_file":"documents",'
            || '"line_number":null,"array_index":null,"row_group":0,"row_index":' || rec_ord
            || '}},"field_name":null,"related_location":null,"detail":"' || detail
            || '","pii_category":null,"span":null,"score":' || CAST(score AS VARCHAR) || '}}' AS json
        FROM ({quality('documents', 'text', 50)}) WHERE category = 'low_quality_short'""",
    "explorer_search": "SELECT doc_id FROM documents WHERE contains(lower(text), 'the')",
    "explorer_clean": f"""WITH {PII} SELECT doc_id FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM pii)""",
    "explorer_category": f"SELECT doc_id FROM documents WHERE {tokens('text')} < 50",
    "explorer_page": "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 12 OFFSET 24",
    "explorer_pages": "SELECT CAST(ceil(count(*) / 12.0) AS BIGINT) AS pages FROM documents",
    "explorer_preview": """SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...'
        ELSE text END AS preview, 'Group 0, Row ' || doc_id AS label FROM documents""",
    "record_categories": f"""{ISSUES} SELECT rec_ord AS doc_id,
        string_agg(category, ',' ORDER BY category_ord) AS categories
        FROM (SELECT DISTINCT rec_ord, category, category_ord FROM issues JOIN category USING (category))
        GROUP BY 1""",
    "record_issue_nest": f"""{ISSUES}, n AS (
        SELECT rec_ord, count(*) AS n_issues, bool_or(category = 'pii') AS is_redacted
            FROM issues GROUP BY 1), c AS (
        SELECT rec_ord, string_agg(category, ',' ORDER BY category_ord) AS categories
            FROM (SELECT DISTINCT rec_ord, category, category_ord FROM issues JOIN category USING (category))
            GROUP BY 1)
        SELECT row_number() OVER (ORDER BY doc_id) - 1 AS index,
            coalesce(n_issues, 0) AS n_issues, coalesce(categories, '') AS categories,
            coalesce(is_redacted, false) AS is_redacted
        FROM documents LEFT JOIN n ON n.rec_ord = doc_id LEFT JOIN c ON c.rec_ord = doc_id""",
    "record_numbers": """SELECT o_orderkey * 100003 AS rec_ord,
        row_number() OVER (ORDER BY o_orderkey) - 1 AS rec_idx FROM orders""",
    "exact_duplicate_customers": exact_issues("customer", "c_custkey", "c_mktsegment, c_nationkey"),
    "near_duplicate_customers": near_issues(
        "customer", "c_custkey", "c_mktsegment, c_nationkey",
        "concat_ws(' ', c_mktsegment, c_nationkey)", 0.3,
    ),
    "json_roundtrip": "SELECT doc_id, text, lang FROM documents",
    "jsonl_roundtrip": "SELECT doc_id, text, lang FROM documents",
    "csv_roundtrip": "SELECT doc_id, text, lang FROM documents",
    "parquet_roundtrip": "SELECT doc_id, text, lang FROM documents",
    "parquet_coordinates": """SELECT count(*) AS n_records, count(*) AS n_right, true AS several_groups
        FROM orders""",
    "jsonl_lines": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "csv_lines": """SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS place,
        o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, o_orderpriority FROM orders""",
    "mixed_folder_contents": """SELECT min(doc_id) AS doc_id, 2 * count(*) AS n_records
        FROM documents GROUP BY doc_id, text, lang""",
    "csv_width_errors": """SELECT CASE WHEN c_custkey % 3 = 0 THEN 'parse_error' ELSE 'record' END AS kind,
        row_number() OVER (ORDER BY c_custkey) + 1 AS line_number,
        CASE WHEN c_custkey % 3 = 0 THEN 'CSV row on line ' || (row_number() OVER (ORDER BY c_custkey) + 1)
            || ' has 3 fields but the header declares 2' ELSE c_name || ', key' END AS detail FROM customer""",
    "parse_errors": """SELECT 'parse_error' AS category, 'Malformed JSON on line '
        || row_number() OVER (ORDER BY c_custkey) || ': Expecting value: line 1 column 1 (char 0)'
        AS detail, 1::BIGINT AS n FROM customer WHERE trim(c_name) <> ''""",
    "first_unrepresentable_value": """SELECT min(place) FILTER (label = 7 AND embedding IS NOT NULL) AS record_index,
        'embedding' AS field_name, count(*) AS n_records
        FROM (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings)""",
    "export_field_names": f"""WITH joined AS ({LABELLED}), kinds AS (
            SELECT 0 AS pos, 'text' AS name, CASE WHEN text IS NULL THEN 'null' ELSE 'string' END AS kind FROM joined
            UNION ALL SELECT 1, 'lang', CASE WHEN lang IS NULL THEN 'null' ELSE 'string' END FROM joined
            UNION ALL SELECT 2, 'quality', CASE WHEN quality IS NULL THEN 'null' ELSE 'integer' END FROM joined
            UNION ALL SELECT 3, 'toxic', CASE WHEN toxic IS NULL THEN 'null' ELSE 'integer' END FROM joined)
        SELECT pos, name, string_agg(DISTINCT kind, ',' ORDER BY kind) AS types FROM kinds GROUP BY pos, name""",
    "round_trip_differences": "SELECT count(*) AS n_different FROM documents WHERE false",
}
