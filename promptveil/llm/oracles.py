"""The queries that SQL can express, as DuckDB SQL."""

from __future__ import annotations

from promptveil.llm import licenses, link_graph, vector_codes

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
_DRAWS = ", ".join(f"('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{s // 4}'), {1 + 8 * (s % 4)}, 8))::BIGINT"
                   " / 4294967296.0" for s in range(32))

OP4 = f"""
WITH sizes AS (SELECT doc_id, source, {_WORDS} AS size, [{_DRAWS}] AS draws FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS weight FROM per),
ranked AS (SELECT *, 3 * source_size / weight AS ratio,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0))::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS level
  FROM weighed WINDOW w AS (ORDER BY 3 * source_size / weight, source IS NULL, source
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT level FROM ranked WHERE level <= ratio ORDER BY ratio, level LIMIT 1),
rates AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, (SELECT level FROM final) * weight) AS target,
    CASE WHEN source_size > 0 THEN least((3 * source_size)::DOUBLE, (SELECT level FROM final) * weight) / source_size
         ELSE 0 END AS rate FROM ranked),
seeds AS (SELECT r.source, s.seed, abs(floor(rate) * source_size
      + sum(CASE WHEN draws[s.seed + 1] < rate - floor(rate) THEN size ELSE 0 END) - target) AS off
  FROM rates r JOIN sizes d ON r.source IS NOT DISTINCT FROM d.source, range(32) s(seed)
  GROUP BY r.source, s.seed, rate, source_size, target),
best AS (SELECT source, seed FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY off, seed) AS n FROM seeds)
  WHERE n = 1)
SELECT d.doc_id, d.size, r.source_size, r.target,
  (d.size * (floor(r.rate) + CASE WHEN d.draws[b.seed + 1] < r.rate - floor(r.rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sizes d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source JOIN best b ON b.source IS NOT DISTINCT FROM r.source
"""



def _count(words: str) -> str:
    return f"((length({words}) - length(replace({words}, ' ', ''))) // 2)"


def _op3() -> str:
    rows = ",\n".join(f"({n}, '{label}', '{licenses.spaced(expr)}', {priority}, {score}::DOUBLE)"
                      for n, (label, _, expr, priority, score) in enumerate(licenses.rules()))
    n, first, last, labels = [], [], [], []
    for phrase, label in licenses.BASE:
        cut, size = f"string_split(line, '{licenses.spaced(phrase)}')", len(phrase.split())
        n.append(f"len({cut}) - 1")
        first.append(f"CASE WHEN len({cut}) > 1 THEN {_count(f'{cut}[1]')} END")
        last.append(f"CASE WHEN len({cut}) > 1 THEN n_words - {size} - {_count(f'{cut}[-1]')} END")
        labels.append(f"CASE WHEN len({cut}) > 1 THEN '{label}' END")
    reach = " ".join(f"WHEN {p} THEN max(CASE WHEN priority <= {p} THEN stop END) OVER w"
                     for p in sorted({r[3] for r in licenses.rules()}))
    return f"""
WITH lines AS (SELECT doc_id, CASE WHEN t = '' THEN '' ELSE ' ' || t || ' ' END AS line FROM (SELECT doc_id, trim(
    regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', '  ', 'g'), ' ') AS t FROM documents)),
counted AS (SELECT *, {_count('line')}::BIGINT AS n_words FROM lines),
base AS (SELECT doc_id, n_words, ({' + '.join(n)})::BIGINT AS n_base, least({', '.join(first)})::BIGINT AS first_word,
    greatest({', '.join(last)})::BIGINT AS last_word, list_filter([{', '.join(labels)}], lambda x: x IS NOT NULL) AS found
  FROM counted),
rules(rule, label, expr, priority, score) AS (VALUES {rows}),
cut AS (SELECT doc_id, rule, label, priority, score, string_split_regex(line, expr) AS gaps,
    regexp_extract_all(line, expr) AS hits FROM lines JOIN rules ON regexp_matches(line, expr)),
steps AS (SELECT doc_id, rule, label, priority, score, unnest(range(1, len(hits) + 1)) AS n,
    unnest(gaps[1:len(hits)]) AS gap, unnest(hits) AS hit FROM cut),
placed AS (SELECT *, sum({_count('gap')} + {_count('hit')}) OVER (PARTITION BY doc_id, rule ORDER BY n) AS stop FROM steps),
spans AS (SELECT doc_id, rule, label, priority, score, stop - {_count('hit')} AS start, stop FROM placed),
reached AS (SELECT *, coalesce(CASE priority {reach} END, -1) AS reach FROM spans
  WINDOW w AS (PARTITION BY doc_id ORDER BY start, stop DESC, priority, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
own AS (SELECT doc_id, list(DISTINCT label) AS own, max(score) AS best FROM reached WHERE reach < stop GROUP BY doc_id)
SELECT doc_id, n_words, n_base, first_word, last_word, array_to_string(list_sort(found), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(found, coalesce(own, [])))), ',') AS labels,
  greatest(CASE WHEN n_base > 0 THEN {licenses.BASE_SCORE} ELSE 0 END, coalesce(best, 0))::DOUBLE AS score
FROM base LEFT JOIN own USING (doc_id)"""


def _op11() -> str:
    """The components of all parts as rows; a codebook and an assignment table for each round."""
    steps = []
    for n in range(vector_codes.ROUNDS + 1):
        steps.append(f"""far{n} AS MATERIALIZED (SELECT v.row, v.p, c.e, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS far
  FROM component v JOIN book{n} c USING (p, i) GROUP BY ALL),
near{n} AS MATERIALIZED (SELECT row, p, min(far) AS far, arg_min(e, (far, e)) AS e FROM far{n} GROUP BY ALL),
moved{n} AS (SELECT p, e, i, sum(x)::BIGINT AS total, count(*) AS n FROM component JOIN near{n} USING (row, p) GROUP BY ALL),
book{n + 1} AS MATERIALIZED (SELECT p, e, i, coalesce((total - ((total % n) + n) % n) // n, x) AS x
  FROM book{n} LEFT JOIN moved{n} USING (p, e, i))""")
    last, parts = vector_codes.ROUNDS, vector_codes.PARTS
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, vec_id, label,
    list_transform(embedding, lambda x: floor({vector_codes.SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
component AS MATERIALIZED (SELECT row, (n - 1) // (size // {parts}) AS p, (n - 1) % (size // {parts}) AS i, x
  FROM (SELECT row, len(v) AS size, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS n FROM kept)),
book0 AS MATERIALIZED (SELECT p, row - 1 AS e, i, x FROM component WHERE row <= {vector_codes.ENTRIES}),
{", ".join(steps)},
coded AS (SELECT row, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM near{last} GROUP BY row)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) FROM book{last}) AS codebooks_sha256
FROM kept JOIN coded USING (row)"""


OP12 = r"""
WITH words AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
docs AS MATERIALIZED (SELECT row, doc_id, terms, len(terms) AS n FROM words WHERE len(terms) > 0),
size AS (SELECT count(*) AS n, sum(n)::BIGINT AS l FROM docs),
posting AS MATERIALIZED (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM docs) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * (SELECT n FROM size) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM posting GROUP BY term),
asked AS (SELECT item_id, text, term, count(*) AS times FROM (SELECT item_id, text, unnest(regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
scored AS (SELECT item_id, text, doc_id, row,
    sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * docs.n * size.n) // size.l))))::BIGINT AS score
  FROM asked JOIN weight USING (term) JOIN posting USING (term) JOIN docs USING (row), size GROUP BY ALL),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST)
    ::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def _op13() -> str:
    """A table of amounts for each round of propagation."""
    mass, passed = link_graph.MASS, link_graph.PASSED
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in link_graph.RULES)
    rounds = [f"""fresh{n + 1} AS MATERIALIZED (SELECT kind, dst AS host, sum((fresh * {passed}) // (100 * n))::BIGINT AS fresh
  FROM fresh{n} f JOIN edges e USING (kind) JOIN degrees d USING (kind, src) WHERE e.src = f.host GROUP BY ALL)"""
              for n in range(link_graph.ROUNDS)]
    every = " UNION ALL ".join(f"SELECT kind, host, (fresh * {100 - passed}) // 100 AS mass FROM fresh{n}"
                               for n in range(link_graph.ROUNDS + 1))
    href = link_graph.HREF.replace("'", "''")
    return f"""
WITH parts AS (SELECT row_number() OVER () AS row, page_id, html, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(own, start, verdict) AS (VALUES {rules}),
hits AS (SELECT row, arg_max((own || start, verdict), (len(own) + len(start), len(own))) AS found FROM parts JOIN rules
  ON (host = own OR ends_with(host, '.' || own)) AND starts_with(path, start) GROUP BY row),
ruled AS MATERIALIZED (SELECT row, page_id, host, path, found[1] AS rule, found[2] AS verdict FROM parts LEFT JOIN hits USING (row)),
hosts AS (SELECT host, count(*) AS n, count(*) FILTER (verdict = 'allow') AS n_allow, count(*) FILTER (verdict = 'block') AS n_block
  FROM ruled WHERE host <> '' GROUP BY host),
seeds AS (SELECT CASE WHEN 2 * n_allow > n THEN 'trust' ELSE 'distrust' END AS kind, host FROM hosts
  WHERE 2 * n_allow > n OR 2 * n_block > n),
links AS (SELECT DISTINCT host AS a, translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS b
  FROM (SELECT host, unnest(regexp_extract_all(html, '{href}', 1)) AS name FROM parts WHERE host <> '')),
edges AS MATERIALIZED (SELECT 'trust' AS kind, a AS src, b AS dst FROM links WHERE a <> b
  UNION ALL SELECT 'distrust', b, a FROM links WHERE a <> b),
degrees AS MATERIALIZED (SELECT kind, src, count(*) AS n FROM edges GROUP BY ALL),
fresh0 AS MATERIALIZED (SELECT kind, host, {mass} // (count(*) OVER (PARTITION BY kind)) AS fresh FROM seeds),
{", ".join(rounds)},
masses AS (SELECT host, coalesce(sum(mass) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(mass) FILTER (kind = 'distrust'), 0)
  AS distrust FROM ({every}) GROUP BY host),
bad AS (SELECT host AS of FROM masses WHERE distrust > trust AND distrust >= {mass} // greatest(1, (SELECT count(*) FROM hosts)))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN of IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM ruled LEFT JOIN bad ON host = of"""


ORACLES: dict[str, str] = {"op3_licenses": _op3(), "op4_mix": OP4, "op11_vector_codes": _op11(),
                           "op12_ranked_search": OP12, "op13_url_filter": _op13()}
