"""The SQL each registered query is checked against, written for DuckDB over the same tables."""

from __future__ import annotations

from promptveil.functions.text import UPPER
from promptveil.operators.auth import DETAILS
from promptveil.operators.decisions import LEAK_DETAIL, RATE_DETAIL, THREAT_DETAIL
from promptveil.operators.providers import ECHO_PREFIX, UPSTREAM_ERROR, UPSTREAM_MISSING
from promptveil.settings import DEFAULT_MODEL
from promptveil.sources.demo_requests import START

# The personal-data patterns in a dialect without look-around and with ASCII word boundaries; they agree with the
# originals once accented letters are out of the way (`accents` below).
PII = {
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "CREDIT_CARD": r"\b(?:\d[ -]?){13,16}\b",
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "IP": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "PHONE": r"(?:\B\+\d{1,3}[ .-]?(?:\(\d{2,4}\)[ .-]?)?|\b\d{1,3}[ .-]?(?:\(\d{2,4}\)[ .-]?)?|\B\(\d{2,4}\)[ .-]?|\b)"
             r"\d{3}[ .-]?\d{3,4}\b",
    "ADDRESS": r"(?i)\b\d[\d\-–]*\s+[A-Za-z][\w\s]{1,40}?\b(?:street|st\.?|avenue|ave\.?|road|rd\.?|lane|ln\.?|drive"
               r"|dr\.?|court|ct\.?|place|pl\.?|boulevard|blvd\.?|way|row|square|sq\.?|gardens?|terrace|crescent|close"
               r"|mews|walk)\b",
}
WORDS = r"[\p{L}\p{N}_]+"


def fold(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{UPPER.lower()}')"


def accents(text: str) -> str:
    return f"regexp_replace({text}, '[À-ɏ]', 'z', 'g')"


def pieces(length: int) -> str:
    """All consecutive pieces of column text, the last one with the rest."""
    count = f"greatest(1, length(text) // {length})"
    return (f"list_transform(range(0, {count}), lambda n: substr(text, n * {length} + 1, CASE WHEN n = {count} - 1 "
            f"THEN length(text) ELSE {length} END))")


def phrases(length: int = 30, part: int | None = None) -> str:
    cut = (f"SELECT item_id, unnest(range(0, len(ps))) AS n, unnest(ps) AS name FROM (SELECT item_id, {pieces(length)} AS ps "
           "FROM benchmark WHERE text <> '')")
    side = "" if part is None else f" WHERE n % 2 = {part}"
    return f"(SELECT (item_id * 1000 + n)::INT AS sig_id, {fold('name')} AS p, name FROM ({cut}){side})"


def hits(source: str, key: str, text: str, length: int = 30, part: int | None = None) -> str:
    """Rows (key, sig_id, name, p, f, first_end) of the texts' distinct hits."""
    return (f"(SELECT {key}, sig_id, name, p, f, strlen(substr(f, 1, instr(f, p) - 1)) + strlen(p) AS first_end "
            f"FROM (SELECT {key}, {fold(text)} AS f FROM {source}) JOIN {phrases(length, part)} ON contains(f, p))")


def weave(gaps: str, parts: str) -> str:
    return (f"array_to_string(list_transform(range(1, len({gaps}) + 1), lambda i: {gaps}[i] || "
            f"CASE WHEN i <= len({parts}) THEN {parts}[i] ELSE '' END), '')")


def pii_ctes(source: str, keys: str, text: str) -> str:
    """CTEs that end in ``pii`` (keys, t, v_EMAIL, ...): numbered text and, per label, its distinct values in order."""
    out, previous, kept = [f"p0 AS (SELECT {keys}, {text} AS t FROM {source})"], "p0", ""
    for n, (label, pattern) in enumerate(PII.items()):
        name = f"v_{label}"
        out.append(f"h{n} AS (SELECT {keys}{kept}, regexp_extract_all(t, '{pattern}') AS h, "
                   f"string_split_regex(t, '{pattern}') AS g FROM {previous})")
        out.append(f"d{n} AS (SELECT *, list_filter(h, lambda x, i: list_position(h, x) = i) AS {name} FROM h{n})")
        out.append(f"n{n} AS (SELECT *, list_transform(h, lambda x: '[{label}_' || list_position({name}, x) || ']') "
                   f"AS named FROM d{n})")
        woven = weave("g", "named")
        kept += f", {name}"
        out.append(f"p{n + 1} AS (SELECT {keys}{kept}, {accents(woven) if n == 0 else woven} AS t FROM n{n})")
        previous = f"p{n + 1}"
    out.append(f"pii AS (SELECT * FROM {previous})")
    return ", ".join(out)


def pii_entries(keys: str) -> str:
    """Rows (keys, label, idx, original) from ``pii``."""
    return " UNION ALL ".join(
        f"SELECT {keys}, '{label}' AS label, unnest(range(1, len(v_{label}) + 1)) AS idx, "
        f"{accents(f'unnest(v_{label})')} AS original FROM pii" for label in PII)


TOTAL = " + ".join(f"len(v_{label})" for label in PII)


def bucket_ctes(source: str, capacity: int, seconds_per_token: int) -> str:
    """CTEs that end in ``metered`` (event_id, user_id, us, offered) for ``source`` (event_id, user_id, us)."""
    token = seconds_per_token * 1_000_000
    left = f"(CASE WHEN f.offered >= {token} THEN f.offered - {token} ELSE f.offered END)"
    return f"""
    ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rn FROM {source}),
    metered AS (
      SELECT event_id, user_id, us, rn, {capacity * token}::BIGINT AS offered FROM ev WHERE rn = 1
      UNION ALL
      SELECT e.event_id, e.user_id, e.us, e.rn, least({capacity * token}, {left} + greatest(0, e.us - f.us))
      FROM metered f JOIN ev e ON e.user_id = f.user_id AND e.rn = f.rn + 1)"""


def bucket_columns(seconds_per_token: int) -> str:
    token = seconds_per_token * 1_000_000
    wait = f"({token} - offered)::DOUBLE / 1000000::DOUBLE"
    return f"""event_id, user_id, offered >= {token} AS allowed,
    CASE WHEN offered >= {token} THEN 0.0::DOUBLE ELSE {wait} END AS retry_after,
    CASE WHEN offered < {token} THEN greatest(1, round_even({wait}, 0))::BIGINT END AS retry_after_header,
    (CASE WHEN offered >= {token} THEN offered - {token} ELSE offered END)::DOUBLE / {token}::DOUBLE AS remaining"""


EVENTS = "(SELECT event_id, user_id, epoch_us(ts) AS us FROM events)"
RATES = f"WITH RECURSIVE {bucket_ctes(EVENTS, 3, 86400)} SELECT {bucket_columns(86400)} FROM metered"


def reason(key: str) -> str:
    return (f"CASE {key} % 12 WHEN 0 THEN 'missing_header' WHEN 1 THEN 'malformed_header' WHEN 2 THEN 'expired' "
            "WHEN 3 THEN 'bad_signature' WHEN 4 THEN 'missing_sub' WHEN 5 THEN 'malformed_token' "
            "WHEN 6 THEN 'empty_sub' END")


CONVERSATION = ("(SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS joined, "
                "string_agg(role, '>' ORDER BY turn) AS roles, count(*) AS n_messages FROM conversations "
                "GROUP BY conv_id)")

CHAT_MODEL = f"CASE WHEN conv_id % 3 = 1 THEN 'model-a' ELSE '{DEFAULT_MODEL}' END"

TURNS = """(SELECT conv_id, turn, conv_id % 17 = 5 AS empty, conv_id % 11 = 3 AS tool, (conv_id + turn) % 13 = 4 AS blank,
  text, (CASE conv_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 40000 WHEN 2 THEN NULL ELSE 500 END)::INT AS given
  FROM conversations)"""
INVALID = """CASE WHEN empty THEN 'no_messages' WHEN tool THEN 'bad_role' WHEN blank THEN 'no_content'
  WHEN NOT coalesce(given, 1024) BETWEEN 1 AND 32000 THEN 'bad_max_tokens' END"""

NAMES = f"""names AS (SELECT {fold('word')} AS w, first(label ORDER BY word, label) AS label FROM (
    SELECT * FROM (SELECT unnest(regexp_extract_all(text, '{WORDS}')) AS word,
      ['PERSON', 'GPE', 'LOC', 'ORG'][(item_id % 4) + 1] AS label FROM benchmark)
    WHERE length(word) >= 6 AND word <> lower(word)) GROUP BY w),
  cut AS (SELECT doc_id, regexp_extract_all(text, '{WORDS}') AS toks, string_split_regex(text, '{WORDS}') AS gaps
    FROM documents),
  toks AS (SELECT doc_id, unnest(range(1, len(toks) + 1)) AS i, unnest(toks) AS tok,
    unnest(list_slice(gaps, 1, len(toks))) AS gap FROM cut),
  placed AS (SELECT doc_id, tok, sum(length(gap) + length(tok)) OVER (PARTITION BY doc_id ORDER BY i
    ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM toks),
  spans AS (SELECT doc_id, tok, stop - length(tok) AS start, stop, label FROM placed JOIN names ON {fold('tok')} = w)"""
ENTITY_VAULT = f"""WITH {NAMES} SELECT doc_id, label,
    row_number() OVER (PARTITION BY doc_id, label ORDER BY max(start) DESC) AS idx, tok AS original
    FROM spans GROUP BY doc_id, label, tok"""


LONG_WORDS = f"""(SELECT doc_id, count(*) AS n FROM (SELECT doc_id, {fold('text')} AS f FROM documents) JOIN (
    SELECT DISTINCT {fold('word')} AS p FROM (SELECT unnest(regexp_extract_all(text, '{WORDS}')) AS word FROM benchmark)
    WHERE length(word) >= 8) ON contains(f, p) GROUP BY doc_id)"""


def flow_ctes(echo: bool, threats: str | None = None) -> str:
    """CTEs that end in ``flow``, one row per document request with all stage results."""
    threats = threats or f"(SELECT doc_id, count(*) AS n FROM {hits('documents', 'doc_id', 'text', 30, 0)} GROUP BY doc_id)"
    leak_text = f"(SELECT doc_id, '{ECHO_PREFIX}' || t AS r FROM pii)" if echo else "replies"
    if echo:  # its texts have had their accents removed, so the signatures have to as well
        leaks = (f"(SELECT doc_id, count(*) AS n FROM (SELECT doc_id, {fold('r')} AS f FROM {leak_text}) JOIN "
                 f"(SELECT {accents('p')} AS p FROM {phrases(30, 1)}) ON contains(f, p) GROUP BY doc_id)")
    else:
        leaks = (f"(SELECT doc_id, count(*) AS n FROM {hits(leak_text, 'doc_id', 'r', 30, 1)} GROUP BY doc_id)")
    proxy = "NULL" if echo else (f"CASE WHEN r.doc_id IS NULL THEN '{UPSTREAM_MISSING}' "
                                 f"WHEN r.status <> 200 THEN '{UPSTREAM_ERROR}' END")
    token = 3600 * 1_000_000
    details = " ".join(f"WHEN '{name}' THEN '{text.replace(chr(39), chr(39) * 2)}'" for name, text in DETAILS.items())
    takers = (f"(SELECT doc_id AS event_id, 'user-' || (doc_id % 17) AS user_id, ({START} + doc_id * 37) * 1000000 AS us"
              " FROM documents WHERE doc_id % 12 >= 7)")
    return f"""
    {bucket_ctes(takers, 3, 3600)},
    {pii_ctes('documents', 'doc_id', 'text')},
    replies AS (SELECT doc_id - 1 AS doc_id, CASE WHEN doc_id % 13 = 1 THEN 500 ELSE 200 END AS status,
      CASE WHEN doc_id % 13 <> 1 THEN 'Re: [EMAIL_1] [CREDIT_CARD_1] ' || text END AS r, text AS rest
      FROM documents WHERE doc_id % 13 <> 0),
    threats AS {threats},
    leaks AS {leaks},
    joined AS (SELECT d.doc_id, 'doc-' || d.doc_id AS request_id, ({START} + d.doc_id * 37) * 1000000 AS us,
      {reason('d.doc_id')} AS reason, m.offered >= {token} AS allowed,
      CASE WHEN m.offered < {token} THEN greatest(1, round_even(({token} - m.offered)::DOUBLE / 1000000, 0))::BIGINT
      END AS wait, coalesce(t.n, 0) AS threats, {proxy} AS proxy_detail, coalesce(l.n, 0) AS leaks,
      {TOTAL} AS redactions, v_EMAIL, v_CREDIT_CARD, r.rest
      FROM documents d LEFT JOIN metered m ON m.event_id = d.doc_id LEFT JOIN threats t ON t.doc_id = d.doc_id
      LEFT JOIN replies r ON r.doc_id = d.doc_id LEFT JOIN leaks l ON l.doc_id = d.doc_id
      JOIN pii ON pii.doc_id = d.doc_id),
    staged AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'auth' WHEN NOT allowed THEN 'ratelimit'
      WHEN threats > 0 THEN 'threatscan' WHEN proxy_detail IS NOT NULL THEN 'proxy' WHEN leaks > 0 THEN 'egress' END
      AS stage FROM joined),
    flow AS (SELECT request_id, us AS micros,
      CASE WHEN reason IS NULL THEN 'user-' || (doc_id % 17) END AS user_id,
      '10.0.0.' || (doc_id % 250) AS client_ip,
      CASE WHEN stage IS NULL THEN 'allowed' ELSE 'rejected' END AS decision, stage AS terminating_stage,
      (CASE stage WHEN 'auth' THEN 401 WHEN 'ratelimit' THEN 429 WHEN 'threatscan' THEN 403 WHEN 'proxy' THEN 502
        WHEN 'egress' THEN 502 ELSE 200 END)::BIGINT AS status_code,
      reason IS NULL AS jwt_valid, coalesce(stage = 'ratelimit', false) AS rate_limited,
      (CASE WHEN stage IN ('auth', 'ratelimit') THEN 0 ELSE threats END)::BIGINT AS ingress_hits,
      (CASE WHEN stage IN ('auth', 'ratelimit', 'threatscan', 'proxy') THEN 0 ELSE leaks END)::BIGINT AS egress_hits,
      (CASE WHEN stage IN ('auth', 'ratelimit', 'threatscan') THEN 0 ELSE redactions END)::BIGINT AS redactions,
      '{"mock" if echo else "anthropic"}' AS provider, (doc_id % 400) / 4.0::DOUBLE AS latency_ms,
      CASE stage WHEN 'auth' THEN (CASE reason {details} END) WHEN 'ratelimit' THEN '{RATE_DETAIL}'
        WHEN 'threatscan' THEN '{THREAT_DETAIL}' WHEN 'proxy' THEN proxy_detail WHEN 'egress' THEN '{LEAK_DETAIL}' END
      AS detail, CASE WHEN stage = 'ratelimit' THEN wait::VARCHAR END AS retry_after,
      doc_id, v_EMAIL, v_CREDIT_CARD, rest FROM staged)"""


FLOW = f"WITH RECURSIVE {flow_ctes(echo=False)} "
ECHO_FLOW = f"WITH RECURSIVE {flow_ctes(echo=True)} "
AUDIT_COLUMNS = ("request_id, micros, user_id, client_ip, decision, terminating_stage, status_code, jwt_valid, "
                 "rate_limited, ingress_hits, egress_hits, redactions, provider, latency_ms")

SCAN = f"SELECT doc_id, sig_id, first_end::BIGINT AS first_end FROM {hits('documents', 'doc_id', 'text')}"
SHORT_CONV = (f"SELECT conv_id, count(*) AS n_hits FROM {hits(CONVERSATION, 'conv_id', 'joined', 6)} "
              "GROUP BY conv_id")
PII_DOCS = f"WITH {pii_ctes('documents', 'doc_id', 'text')} "
SOURCES = f"""WITH {pii_ctes('documents', 'doc_id, source', 'text')},
  entries AS ({pii_entries('doc_id, source')}),
  firsts AS (SELECT source, label, original, min((doc_id, idx)) AS f FROM entries GROUP BY source, label, original),
  vault AS (SELECT source AS request_id, label, row_number() OVER (PARTITION BY source, label ORDER BY f) AS idx,
    original FROM firsts) """
PLACEHOLDERS = r"\[[A-Z_]+_[0-9]+\]"

ORACLES: dict[str, str] = {
    "conv_requests": f"SELECT conv_id, n_messages, roles, joined FROM {CONVERSATION}",
    "validate_requests": f"SELECT conv_id, turn, {INVALID} AS invalid_reason, coalesce(given, 1024)::INT AS max_tokens "
                         f"FROM {TURNS}",
    "quarantined_requests": f"SELECT {INVALID} AS invalid_reason, count(*) AS n FROM {TURNS} "
                            f"WHERE {INVALID} IS NOT NULL GROUP BY 1",
    "request_parse": f"""SELECT conv_id, turn, conv_id % 9 <> 0 AS parsed,
        CASE WHEN conv_id % 9 <> 0 THEN (CASE WHEN empty THEN 0 ELSE 1 END)::BIGINT END AS n_messages,
        CASE WHEN conv_id % 9 <> 0 AND NOT empty AND NOT blank THEN text END AS content,
        CASE WHEN conv_id % 9 <> 0 THEN 'model-b' END AS model,
        CASE WHEN conv_id % 9 <> 0 THEN given END AS max_tokens FROM {TURNS}""",
    "stored_requests": f"""SELECT 'doc-' || doc_id AS request_id, ({START} + doc_id * 37) * 1000000 AS micros,
        '10.0.0.' || (doc_id % 250) AS client_ip, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'model-a' END AS model,
        (CASE WHEN doc_id % 5 = 0 THEN 1024 ELSE 256 END)::INT AS max_tokens, md5(text) AS content_md5
        FROM documents""",
    "signature_file": f"""SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY n % 2, n) - 1)::INT AS sig_id,
        category, pattern, category || ':' || pattern AS name FROM (SELECT item_id, n,
          CASE n % 2 WHEN 0 THEN 'first' ELSE 'second' END AS category, pattern FROM (
            SELECT item_id, unnest(range(0, len(ps))) AS n, unnest(ps) AS pattern
            FROM (SELECT item_id, {pieces(12)} AS ps FROM benchmark)))""",
    "pattern_count": f"SELECT (coalesce(max(CASE WHEN (sig_id // 1000) % 5 <> 4 AND p <> '' THEN sig_id END) + 1, 0))::INT "
                     f"AS pattern_count FROM {phrases()}",
    "scan_distinct": SCAN,
    "scan_join": SCAN,
    "scan_offsets": f"""SELECT doc_id, sig_id, strlen(substr(f, 1, pos - 1))::BIGINT AS start,
        (strlen(substr(f, 1, pos - 1)) + strlen(p))::BIGINT AS "end"
        FROM (SELECT *, unnest(range(1, length(f) - length(p) + 2)) AS pos
              FROM {hits('documents', 'doc_id', 'text')}) WHERE substr(f, pos, length(p)) = p""",
    "scan_names": f"""SELECT doc_id, string_agg(name, '|' ORDER BY first_end, -strlen(p), sig_id) AS names
        FROM {hits('documents', 'doc_id', 'text')} GROUP BY doc_id""",
    "scan_hit_counts": f"SELECT doc_id, count(*) AS n_hits FROM {hits('documents', 'doc_id', 'text', 6)} "
                       "GROUP BY doc_id",
    "scan_blocked": f"SELECT doc_id, md5(text) AS text_md5 FROM documents d WHERE EXISTS "
                    f"(SELECT 1 FROM {phrases()} WHERE contains({fold('d.text')}, p))",
    "scan_clean": f"SELECT doc_id, md5(text) AS text_md5 FROM documents d WHERE NOT EXISTS "
                  f"(SELECT 1 FROM {phrases()} WHERE contains({fold('d.text')}, p))",
    "ingress_scan": SHORT_CONV,
    "message_scan": SHORT_CONV,
    "egress_scan": f"SELECT page_id, count(*) AS n_hits FROM {hits('pages', 'page_id', 'html', 5)} GROUP BY page_id",
    "pii_vault": f"{PII_DOCS} SELECT doc_id, label, idx, '[' || label || '_' || idx || ']' AS placeholder, original "
                 f"FROM ({pii_entries('doc_id')})",
    "pii_counts": f"{PII_DOCS} SELECT doc_id, label, count(*) AS n FROM ({pii_entries('doc_id')}) GROUP BY 1, 2",
    "pii_redacted": f"{PII_DOCS} SELECT doc_id, ({TOTAL})::BIGINT AS redactions, md5(t) AS scrubbed_md5 FROM pii",
    "pii_restore": "SELECT doc_id, md5(text) AS restored_md5 FROM documents",
    "page_pii_counts": f"WITH {pii_ctes('pages', 'page_id', 'html')} SELECT page_id, label, count(*) AS n "
                       f"FROM ({pii_entries('page_id')}) GROUP BY 1, 2",
    "message_vault": f"{SOURCES} SELECT request_id, label, idx, '[' || label || '_' || idx || ']' AS placeholder, "
                     "original FROM vault",
    "message_redacted": f"""{SOURCES},
        own AS (SELECT e.doc_id, '[' || e.label || '_' || e.idx || ']' AS token,
          '[' || e.label || '_' || v.idx || ']' AS final FROM entries e
          JOIN vault v ON v.request_id = e.source AND v.label = e.label AND v.original = e.original),
        cut AS (SELECT doc_id, source, string_split_regex(t, '{PLACEHOLDERS}') AS g,
          regexp_extract_all(t, '{PLACEHOLDERS}') AS h FROM pii),
        named AS (SELECT doc_id, list(final ORDER BY i) AS parts FROM
          (SELECT doc_id, unnest(range(1, len(h) + 1)) AS i, unnest(h) AS token FROM cut) JOIN own USING (doc_id, token)
          GROUP BY doc_id)
        SELECT source AS request_id, doc_id AS msg_idx, md5({weave('g', 'coalesce(parts, [])')}) AS scrubbed_md5
        FROM cut LEFT JOIN named USING (doc_id)""",
    "entity_spans": f'WITH {NAMES} SELECT doc_id, start, stop AS "end", label FROM spans',
    "entity_spans_join": f'WITH {NAMES} SELECT doc_id, start, stop AS "end", label FROM spans',
    "entity_vault": ENTITY_VAULT,
    "span_vault": ENTITY_VAULT,
    "entity_restored": f"""WITH {NAMES} SELECT doc_id, coalesce(n, 0)::BIGINT AS redactions,
        (length(text) - coalesce(gone, 0))::BIGINT AS rest_length, md5(text) AS restored_md5
        FROM documents LEFT JOIN (SELECT doc_id, count(DISTINCT (label, tok)) AS n, sum(length(tok)) AS gone FROM spans
        GROUP BY doc_id) USING (doc_id)""",
    "rate_outcomes": RATES,
    "rate_outcomes_pieces": "WITH RECURSIVE " + bucket_ctes(
        "(SELECT event_id, user_id % 3 AS user_id, epoch_us(ts) AS us FROM events)", 5, 900)
        + f" SELECT {bucket_columns(900)} FROM metered",
    "stream_rate_outcomes": RATES,
    "auth_outcomes": f"""SELECT event_id, reason IS NULL AS ok, CASE WHEN reason IS NULL THEN user_id::VARCHAR END AS user_id,
        reason, event_id % 12 = 8 AS never_expires FROM (SELECT *, CASE WHEN event_id % 12 = 9 THEN
          ['bad_exp', 'bad_exp', 'bad_exp', 'bad_iat', 'bad_nbf', 'empty_sub', 'empty_sub', 'empty_sub', 'bad_sub'][
            (event_id // 12) % 9 + 1] ELSE {reason('event_id')} END AS reason FROM events)""",
    "metered_events": "WITH RECURSIVE " + bucket_ctes(
        "(SELECT event_id, user_id::VARCHAR AS user_id, epoch_us(ts) AS us FROM events WHERE event_id % 12 >= 7)",
        3, 86400) + f" SELECT {bucket_columns(86400)} FROM metered",
    "provider_body_block": f"""SELECT conv_id::VARCHAR AS request_id, CASE WHEN coalesce(system, '') = ''
        THEN to_json({{'model': {CHAT_MODEL}, 'max_tokens': conv_id % 900 + 1, 'messages': coalesce(turns, [])}})
        ELSE to_json({{'model': {CHAT_MODEL}, 'max_tokens': conv_id % 900 + 1, 'messages': coalesce(turns, []),
          'system': system}}) END::VARCHAR AS body FROM (SELECT conv_id,
          string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'system') AS system,
          list({{'role': role, 'content': text}} ORDER BY turn) FILTER (role IN ('user', 'assistant')) AS turns
          FROM conversations GROUP BY conv_id)""",
    "provider_body_choice": f"""SELECT conv_id::VARCHAR AS request_id, to_json({{'model': {CHAT_MODEL},
        'max_tokens': conv_id % 900 + 1, 'messages': turns}})::VARCHAR AS body FROM (SELECT conv_id,
          list({{'role': role, 'content': text}} ORDER BY turn) AS turns FROM conversations GROUP BY conv_id)""",
    "model_resolution": f"SELECT DISTINCT conv_id, {CHAT_MODEL} AS model FROM conversations",
    "echo_responses": f"""SELECT conv_id, '{ECHO_PREFIX}' || coalesce(arg_max(text, turn) FILTER (role = 'user'), '')
        AS content FROM conversations GROUP BY conv_id""",
    "parse_block": """SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN text || ' and more' WHEN 1 THEN text
        WHEN 2 THEN text ELSE '' END AS content FROM conversations""",
    "parse_choice": """SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN text ELSE '' END AS content
        FROM conversations""",
    "response_join": f"""SELECT 'doc-' || d.doc_id AS request_id, CASE WHEN r.doc_id IS NULL THEN '{UPSTREAM_MISSING}'
        WHEN r.doc_id % 13 = 1 THEN '{UPSTREAM_ERROR}' END AS proxy_detail,
        CASE WHEN r.doc_id % 13 <> 1 THEN md5('Re: [EMAIL_1] [CREDIT_CARD_1] ' || r.text) END AS response_md5
        FROM documents d LEFT JOIN (SELECT * FROM documents WHERE doc_id % 13 <> 0) r ON r.doc_id = d.doc_id + 1""",
    "request_decisions": f"{FLOW} SELECT request_id, decision, terminating_stage, status_code, detail FROM flow",
    "audit_rows_large_dictionary": f"WITH RECURSIVE {flow_ctes(False, LONG_WORDS)} SELECT {AUDIT_COLUMNS} FROM flow",
    "audit_rows": f"{FLOW} SELECT {AUDIT_COLUMNS} FROM flow",
    "response_projection": f"""{FLOW} SELECT request_id, CASE WHEN doc_id % 3 = 1 THEN 'model-a'
        ELSE '{DEFAULT_MODEL}' END AS model, md5({accents("'Re: ' || coalesce(v_EMAIL[1], '[EMAIL_1]') || ' ' || "
        "coalesce(v_CREDIT_CARD[1], '[CREDIT_CARD_1]') || ' ' || rest")}) AS content_md5, redactions
        FROM flow WHERE terminating_stage IS NULL""",
    "rejection_projection": f"""{FLOW} SELECT '' AS request_id, terminating_stage AS stage, status_code, detail,
        retry_after, count(*) AS n FROM flow WHERE terminating_stage IS NOT NULL GROUP BY 1, 2, 3, 4, 5""",
    "source_audit": f"""WITH RECURSIVE
        srcs AS (SELECT DISTINCT source AS request_id, substr(source, 4)::BIGINT AS num FROM documents),
        {bucket_ctes(f"(SELECT request_id AS event_id, (num + 7) % 3 AS user_id, ({START} + num * 60) * 1000000 AS us "
                     "FROM srcs WHERE (num + 7) % 12 >= 7)", 3, 3600)},
        {pii_ctes('documents', 'doc_id, source', 'text')},
        entries AS ({pii_entries('doc_id, source')}),
        firsts AS (SELECT source, label, original, min((doc_id, idx)) AS f FROM entries GROUP BY ALL),
        vault AS (SELECT source, label, row_number() OVER (PARTITION BY source, label ORDER BY f) AS idx, original
          FROM firsts),
        threats AS (SELECT source, count(DISTINCT sig_id) AS n FROM (SELECT source, {fold('text')} AS f FROM documents)
          JOIN {phrases(60)} ON contains(f, p) GROUP BY source),
        joined AS (SELECT s.request_id, num, {reason('(num + 7)')} AS reason, m.offered >= 3600000000 AS allowed,
          coalesce(t.n, 0) AS threats,
          (SELECT count(*) FROM vault v WHERE v.source = s.request_id) AS held,
          (SELECT original FROM vault v WHERE v.source = s.request_id AND label = 'EMAIL' AND idx = 1) AS email,
          (SELECT original FROM vault v WHERE v.source = s.request_id AND label = 'PHONE' AND idx = 2) AS phone
          FROM srcs s LEFT JOIN metered m ON m.event_id = s.request_id LEFT JOIN threats t ON t.source = s.request_id),
        staged AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'auth' WHEN NOT allowed THEN 'ratelimit'
          WHEN threats > 0 THEN 'threatscan' WHEN (num + 7) % 20 = 0 THEN 'proxy' END AS stage FROM joined)
        SELECT request_id, CASE WHEN reason IS NULL THEN ((num + 7) % 3)::VARCHAR END AS user_id,
          CASE WHEN stage IS NULL THEN 'allowed' ELSE 'rejected' END AS decision, stage AS terminating_stage,
          (CASE stage WHEN 'auth' THEN 401 WHEN 'ratelimit' THEN 429 WHEN 'threatscan' THEN 403 WHEN 'proxy' THEN 502
            ELSE 200 END)::BIGINT AS status_code, reason IS NULL AS jwt_valid,
          coalesce(stage = 'ratelimit', false) AS rate_limited,
          (CASE WHEN stage IN ('auth', 'ratelimit') THEN 0 ELSE threats END)::BIGINT AS ingress_hits,
          0::BIGINT AS egress_hits,
          (CASE WHEN stage IN ('auth', 'ratelimit', 'threatscan') THEN 0 ELSE held END)::BIGINT AS redactions,
          'anthropic' AS provider, CASE WHEN stage IS NULL THEN 'Re: ' || coalesce(email, '[EMAIL_1]') || ' '
            || coalesce(phone, '[PHONE_2]') || ' [IP_99999]' END AS answer FROM staged""",
    "audit_upsert": f"""{ECHO_FLOW} SELECT request_id, decision, status_code, terminating_stage,
        CASE WHEN doc_id % 3 = 0 THEN -1.0 ELSE latency_ms END AS latency_ms FROM flow""",
    "echo_audit": f"{ECHO_FLOW} SELECT {AUDIT_COLUMNS} FROM flow",
    "stream_audit": f"{ECHO_FLOW} SELECT {AUDIT_COLUMNS.replace(', latency_ms', '')} FROM flow",
    "audit_by_decision": f"""{FLOW} SELECT day, stage, status_code, count(*) AS n,
        grouping_id(day, stage, status_code)::BIGINT AS level FROM (SELECT
        strftime(make_timestamp(micros), '%Y-%m-%d') AS day, coalesce(terminating_stage, 'none') AS stage, status_code
        FROM flow) GROUP BY ROLLUP (day, stage, status_code)""",
    "audit_by_user": f"""{FLOW} SELECT user_id, count(*) AS n, sum(ingress_hits)::BIGINT AS ingress_hits,
        sum(egress_hits)::BIGINT AS egress_hits, sum(redactions)::BIGINT AS redactions FROM flow GROUP BY user_id""",
    "audit_by_label": f"""{FLOW} SELECT label, count(*)::BIGINT AS redactions, count(DISTINCT doc_id)::BIGINT
        AS requests FROM ({pii_entries('doc_id')}) JOIN (SELECT doc_id FROM flow WHERE terminating_stage IS NULL
        OR terminating_stage IN ('proxy', 'egress')) USING (doc_id) GROUP BY label""",
    "audit_denied_share": f"""{FLOW} SELECT user_id, (micros // 3600000000) * 3600 AS hour, count(*) AS n,
        count(*) FILTER (rate_limited) AS denied, (count(*) FILTER (rate_limited))::DOUBLE / count(*) AS share
        FROM flow WHERE jwt_valid GROUP BY 1, 2""",
    "audit_latency": f"""{FLOW} SELECT coalesce(terminating_stage, 'none') AS stage, count(*) AS n,
        quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95,
        quantile_disc(latency_ms, 0.99) AS p99 FROM flow GROUP BY 1""",
}
ORACLES["source_audit_split"] = ORACLES["source_audit"]
ORACLES["vault_opened"] = ORACLES["pii_vault"]
PLANTED = ("(SELECT doc_id, text || chr(10) || 'id ' || (doc_id % 800 + 100) || '-' || (doc_id % 80 + 10) || '-' || "
           "(doc_id % 8000 + 1000) || ', lives at ' || (doc_id % 200 + 1) || ' Old Mill Road, says so.' AS text FROM documents)")
ORACLES["pii_planted"] = (f"WITH {pii_ctes(PLANTED, 'doc_id', 'text')} SELECT doc_id, label, count(*) AS n "
                          f"FROM ({pii_entries('doc_id')}) GROUP BY 1, 2")
ORACLES["redacted_prompts"] = f"""{FLOW} SELECT request_id, CASE WHEN terminating_stage IS NULL
    OR terminating_stage IN ('proxy', 'egress') THEN md5(t) END AS prompt_md5 FROM flow JOIN pii USING (doc_id)"""
ORACLES["audit_outcomes"] = f"""{ECHO_FLOW} SELECT decision, status_code, terminating_stage, count(*) AS n FROM flow
    GROUP BY ALL"""
ORACLES["stream_repeated_requests"] = ORACLES["stream_audit"]
ORACLES["stream_late_responses"] = f"{FLOW} SELECT {AUDIT_COLUMNS.replace(', latency_ms', '')} FROM flow"
ORACLES["stream_vault"] = f"""{ECHO_FLOW} SELECT request_id, label, idx::BIGINT AS idx, '[' || label || '_' || idx || ']' AS placeholder,
    original FROM ({pii_entries('doc_id')}) JOIN flow USING (doc_id)
    WHERE terminating_stage IS NULL OR terminating_stage IN ('proxy', 'egress')"""
ORACLES["stream_responses"] = f"""{ECHO_FLOW} SELECT request_id, CASE WHEN doc_id % 3 = 1 THEN 'model-a' ELSE '{DEFAULT_MODEL}' END
    AS model, md5('{ECHO_PREFIX}' || text) AS content_md5, redactions FROM flow JOIN documents USING (doc_id)
    WHERE terminating_stage IS NULL"""
ORACLES["stream_quarantine"] = """SELECT 'doc-' || doc_id AS request_id, ['bad_max_tokens', 'no_messages', 'not_json'][doc_id % 9 + 1]
    AS invalid_reason FROM documents WHERE doc_id % 9 < 3"""
ORACLES["rate_outcomes_single"] = "WITH RECURSIVE " + bucket_ctes(
    "(SELECT event_id, user_id % 3 AS user_id, epoch_us(ts) AS us FROM events)", 1, 900) + f" SELECT {bucket_columns(900)} FROM metered"
ORACLES["audit_compacted"] = ORACLES["audit_upsert"]
ORACLES["scan_offsets_cut"] = ORACLES["scan_offsets"]
ORACLES["scan_delta"] = f"{SCAN} WHERE (sig_id // 1000) % 5 > 0 AND doc_id % 6 <> 1"
ORACLES["stream_denied_share"] = ORACLES["audit_denied_share"]
ORACLES["audit_latency_merged"] = f"""{FLOW} SELECT coalesce(terminating_stage, 'none') AS stage, count(*) AS n,
    count(DISTINCT user_id) AS exact, true AS users_near, true AS p50_near, true AS p95_near, true AS p99_near
    FROM flow GROUP BY 1"""
