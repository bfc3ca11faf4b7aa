"""DuckDB SQL for the rows of the registered queries that SQL can express."""

from __future__ import annotations

from strandjoin.llm import url_filter

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def decontamination() -> str:
    """Windows joined by position; every word of a document that one covers is hit."""
    listed = (
        r"list_filter(string_split_regex("
        + LOWER.format("coalesce(text, '')")
        + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
    )
    return rf"""
    WITH i AS (SELECT item_id, {listed} AS w FROM benchmark),
    lengths AS (SELECT DISTINCT least(len(w), 13) AS s FROM i WHERE len(w) > 0),
    windows AS (
      SELECT DISTINCT item_id, s, array_to_string(list_slice(w, p, p + s - 1), ' ') AS t
      FROM (SELECT item_id, w, least(len(w), 13) AS s, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p
            FROM i WHERE len(w) > 0)),
    d AS (SELECT doc_id, {listed} AS w FROM documents),
    places AS (
      SELECT doc_id, s, p, array_to_string(list_slice(w, p, p + s - 1), ' ') AS t
      FROM (SELECT doc_id, w, s, unnest(range(1, len(w) - s + 2)) AS p FROM d, lengths)),
    hits AS (SELECT doc_id, item_id, p, p + windows.s AS e FROM places JOIN windows USING (s, t)),
    covered AS (
      SELECT doc_id, count(DISTINCT q) AS n_hit
      FROM (SELECT doc_id, unnest(range(p, e)) AS q FROM (SELECT DISTINCT doc_id, p, e FROM hits)) GROUP BY 1),
    items AS (
      SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
    SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
      sha256(coalesce(listed, '')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""


def exact_dedup() -> str:
    return r"""
    WITH d AS (
      SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
      FROM documents),
    g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, d.text_sha256
    FROM d JOIN g USING (text_sha256)"""


def url_verdicts() -> str:
    rules = []
    for verdict, rule in url_filter.PATH_RULES:
        name, slash, rest = rule.partition("/")
        rules.append(f"('{verdict}', '{rule}', '{name}', '{slash + rest}')")
    blocked = " OR ".join(
        f"regexp_matches(low, '{expression}')" for expression, _ in url_filter.PATTERNS
    )
    return rf"""
    WITH r(verdict, rule, name, start) AS (VALUES {", ".join(rules)}),
    p AS (
      SELECT page_id, url, {LOWER.format("coalesce(url, '')")} AS low,
        {LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    f AS (
      SELECT page_id, url, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
      FROM p JOIN r ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start)
      GROUP BY ALL)
    SELECT p.page_id, host, path, f.rule,
      coalesce(f.verdict, CASE WHEN {blocked} THEN 'block' ELSE 'allow' END) AS verdict
    FROM p LEFT JOIN f ON p.page_id IS NOT DISTINCT FROM f.page_id AND p.url IS NOT DISTINCT FROM f.url"""


def fixity() -> str:
    """Damaged records and their byte ranges in the order of ids."""
    return """
    WITH r AS (
      SELECT page_id, row_number() OVER w - 1 AS place,
        strlen('WARC/1.1' || 'WARC-Type: resource' || 'WARC-Target-URI: ' || coalesce(url, '')
          || 'WARC-Date: 2020-01-01T00:00:00Z' || 'Content-Type: text/html' || 'Content-Length: '
          || CAST(strlen(coalesce(html, '')) AS VARCHAR)) + 18 + strlen(coalesce(html, '')) AS n,
        strlen(coalesce(html, '')) > 0 AS filled
      FROM pages WINDOW w AS (ORDER BY page_id)),
    o AS (SELECT *, CAST(sum(n) OVER (ORDER BY place) AS BIGINT) AS e FROM r)
    SELECT page_id, place, e - n AS "begin", e AS "end" FROM o WHERE page_id % 97 = 13"""


def phrase_mining() -> str:
    """All phrases counted; every cut of those with 100 occurrences or more; the 2000 best a language."""
    return rf"""
    WITH p AS (
      SELECT coalesce(lang, 'und') AS lang,
        unnest(string_split_regex({LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
    totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
    g AS (
      SELECT lang, k, list_slice(w, i, i + k - 1) AS w
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) t(k))),
    f AS (SELECT lang, k, w, array_to_string(w, ' ') AS phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
    cuts AS (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1),
    scored AS (
      SELECT cuts.*, le.a AS l, ri.a AS r, n, (1000::HUGEINT * cuts.a * n) // (le.a::HUGEINT * ri.a) AS score
      FROM cuts JOIN totals USING (lang)
      JOIN f le ON le.lang = cuts.lang AND le.phrase = array_to_string(list_slice(cuts.w, 1, j), ' ')
      JOIN f ri ON ri.lang = cuts.lang AND ri.phrase = array_to_string(list_slice(cuts.w, j + 1, cuts.k), ' ')),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
    kept AS (
      SELECT * FROM best WHERE NOT EXISTS (
        SELECT 1 FROM f WHERE f.lang = best.lang AND f.k > best.k AND 100 * f.a >= 100 * best.a
          AND contains(' ' || f.phrase || ' ', ' ' || best.phrase || ' '))),
    ranked AS (
      SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
        phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM kept)
    SELECT * FROM ranked WHERE rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": decontamination(),
        "op4_url_filter": url_verdicts(),
        "op7_exact_dedup": exact_dedup(),
        "op8_warc_fixity": fixity(),
        "op13_phrase_mining": phrase_mining(),
    }
