"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from codesift.llm.quality_rules import STOP_WORDS
from codesift.llm.secret_scan import ASSIGN, CLASSES

QUALITY_RULES = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM d
), u AS (
  SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w
), g AS (
  SELECT r, i, lead(i, 2) OVER a AS last, struct_pack(a := word, b := lead(word) OVER a, c := lead(word, 2) OVER a) AS g
  FROM u WINDOW a AS (PARTITION BY r ORDER BY i)
), c AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g WHERE last IS NOT NULL
), hit AS (
  SELECT r, count(DISTINCT j) AS n_repeat_words
  FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM c WHERE n > 1) GROUP BY r
), s AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: list_contains({STOP_WORDS!r}, lower(x))))::BIGINT AS n_stop_words
  FROM w LEFT JOIN hit USING (r)
), f AS (
  SELECT *, list_filter([
    CASE WHEN n_words < 50 THEN 'too_few_words' END,
    CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 'repeated_words' END,
    CASE WHEN word_chars < 2 * n_words OR word_chars > 12 * n_words THEN 'word_length' END,
    CASE WHEN 100 * n_symbols > 10 * n_words THEN 'symbols' END,
    CASE WHEN 100 * n_stop_words < 1 * n_words THEN 'stop_words' END,
    CASE WHEN 100 * n_dup_lines > 40 * n_lines THEN 'repeated_lines' END], lambda x: x IS NOT NULL) AS failed
  FROM s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       len(failed) = 0 AS kept, array_to_string(failed, ',') AS failed_rules
FROM f
"""


def _spans(kind: str, place: int, pattern: str, keep: str) -> str:
    """Rows (r, start, place, kind, end, word) of the matches of a pattern; starts are sums over the pieces before."""
    pattern = pattern.replace("'", "''")
    return f"""
  SELECT r, start, {place} AS place, '{kind}' AS kind, start + length(word) AS "end", word FROM (
    SELECT r, unnest(m) AS word,
           unnest(list_transform(range(1, len(m) + 1), lambda k: list_sum(list_transform(gap[1:k], lambda x: length(x)))
                  + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0)))::BIGINT AS start
    FROM (SELECT r, regexp_extract_all(t, '{pattern}', 0) AS m, string_split_regex(t, '{pattern}') AS gap FROM d
          WHERE regexp_matches(t, '{pattern}'))) WHERE {keep}"""


def _windows(kind: str) -> str:
    """Spans of an entropy class: runs are cut at what is allowed, and every window's counts are taken anew."""
    c = next(x for x in CLASSES if x.kind == kind)
    needs = " AND ".join(f"regexp_matches({{}}, '{x}')" for x in c.needs)
    # one character over and over: written out, as there are no back references here
    runs = "|".join(x + "{6}" for x in [*"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789/_=-", r"\+"])
    allowed = c.allowed.replace(r"(.)\1{5}", runs)
    found = _spans(kind, 3 + CLASSES.index(c), f"[{c.characters}]{{{c.window},}}", needs.format(*["word"] * len(c.needs)))
    window = f"substring(part, (i + 1)::BIGINT, {c.window})"
    return f"""
  SELECT r, start + min(before + i) AS start, place, kind, start + max(before + i) + {c.window} AS "end", word FROM (
    SELECT *, unnest(range(0, length(part) - {c.window - 1})) AS i FROM (
      SELECT *, parts[k] AS part,
             coalesce(list_sum(list_transform(parts[1:k - 1], lambda x: length(x))), 0)
               + coalesce(list_sum(list_transform(gone[1:k - 1], lambda x: length(x))), 0) AS before
      FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS k FROM (
        SELECT *, string_split_regex(word, '{allowed}') AS parts, regexp_extract_all(word, '{allowed}', 0) AS gone
        FROM ({found})))
    ) WHERE length(part) >= {c.window} AND {needs.format(*["part"] * len(c.needs))})
  WHERE list_sum(list_transform(list_distinct(string_split({window}, '')), lambda c:
          list_transform([len(list_filter(string_split({window}, ''), lambda x: x = c))],
                         lambda n: round(n * log2(n) * 1000000))[1]))
        <= floor((log2({c.window}) - {c.bits}) * {c.window} * 1000000)
  GROUP BY r, start, place, kind, word"""


_ENTROPY_SPANS = " UNION ALL ".join(_windows(c.kind) for c in CLASSES)

SECRET_SCAN = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_spans("assign", 0, ASSIGN, "length(regexp_extract(word, '" + ASSIGN.replace("'", "''") + "', 2)) >= 6")}
  UNION ALL {_spans("access", 1, "AKIA[A-Z0-9]+", "length(word) >= 20")}
  UNION ALL {_spans("hex", 2, "[0-9a-f]+", "length(word) >= 24")}),
spans AS (SELECT * FROM base UNION ALL {_ENTROPY_SPANS}),
b AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, place) AS base
  FROM base GROUP BY r
), s AS (
  SELECT r, string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, place) AS spans FROM spans GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN b USING (r) LEFT JOIN s USING (r)
"""

_FOLDED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _FOLDED + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents
), i AS (
  SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL
), p AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + 9], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)
), n AS (SELECT DISTINCT n FROM p),
x AS (
  SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS s
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, n)
), h AS (SELECT r, k, n, item_id FROM x JOIN p USING (n, s)),
c AS (SELECT r, count(DISTINCT j)::BIGINT AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS j FROM h) GROUP BY r),
t AS (
  SELECT r, count(*)::BIGINT AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s
  FROM (SELECT DISTINCT r, item_id FROM h WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""

WARC = """
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, url, coalesce(html, '') AS html FROM pages
), h AS (
  SELECT r, page_id, url, strlen(html)::BIGINT AS payload_bytes, upper(sha1(html)) AS hex FROM p
), d AS (
  SELECT *, row_number() OVER a AS nth, first_value(page_id) OVER a AS first
  FROM h WINDOW a AS (PARTITION BY hex ORDER BY page_id NULLS LAST, url NULLS LAST, r)
)
SELECT page_id, payload_bytes,
       translate(array_to_string(list_transform(range(0, 8), lambda k:
         to_base(('0x' || hex[5 * k + 1:5 * k + 5])::BIGINT, 32, 4)), ''),
         '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN nth > 1 THEN first END AS refers_to
FROM d
"""

_TERMS = "regexp_extract_all(" + _FOLDED + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

LEXICAL_SEARCH = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_TERMS.format("text")} AS t FROM documents WHERE text IS NOT NULL
), i AS (
  SELECT row_number() OVER () AS q, item_id, {_TERMS.format("text")} AS t FROM benchmark WHERE text IS NOT NULL
), s AS (
  SELECT count(*) AS n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0
), f AS (
  SELECT r, any_value(doc_id) AS doc_id, any_value(len(t)) AS len, term, count(*) AS tf
  FROM (SELECT r, doc_id, t, unnest(t) AS term FROM d) GROUP BY r, term
), w AS (
  SELECT term, floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY term, s.n
), x AS (
  SELECT DISTINCT q, item_id, term FROM (SELECT q, item_id, unnest(t) AS term FROM i)
), c AS (
  SELECT q, item_id, r, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * len * s.n) // s.l))))::BIGINT AS score
  FROM x JOIN f USING (term) JOIN w USING (term), s GROUP BY q, item_id, r, doc_id
), k AS (
  SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST, r)::INTEGER AS rank, doc_id, score
  FROM c WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50
"""
