"""DuckDB restatements of the queries of this package that SQL can express.

The others (learned models, tokenizers, text positions) are compared with
plain versions in tests/llm.
"""

from __future__ import annotations

from strata.llm import licenses, urls

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _strength(level: str) -> str:
    """Prior strength of the level with columns n, good, prior."""
    rho = "least(0.5, greatest(1.0 / (1 + 1e4), extra / pairs))"
    return f"""(SELECT CASE WHEN coalesce(pairs, 0) = 0 THEN 1e4 ELSE (1 - {rho}) / {rho} END FROM (
  SELECT sum(pow(good - n * prior, 2) - n * prior * (1 - prior)) AS extra,
         sum(n * (n - 1) * prior * (1 - prior)) AS pairs FROM {level}))"""


def url_judgement(rules) -> str:
    fits = lambda r: (
        f"(host = {_quoted(r.host)} OR ends_with(host, {_quoted('.' + r.host)})) AND starts_with(path, {_quoted(r.path)})"
    )
    longest = sorted(rules, key=lambda r: -len(r.name))
    name = "CASE " + " ".join(f"WHEN {fits(r)} THEN {_quoted(r.name)}" for r in longest) + " END"
    action = "CASE " + " ".join(f"WHEN {fits(r)} THEN {_quoted(r.action)}" for r in longest) + " END"
    two = ", ".join(_quoted(s) for s in urls.TWO_LABEL_SUFFIXES)
    return f"""
WITH outcome AS (
  SELECT doc_id, min(CAST((quality = 1 AND toxic = 0) AS INTEGER)) AS good FROM labels
  WHERE (quality = 1 AND toxic = 0) IS NOT NULL GROUP BY doc_id
),
rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
),
page AS (
  SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
),
bare AS (
  SELECT host, count(good) AS n, coalesce(sum(good), 0) AS good,
         string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS parts
  FROM page LEFT JOIN outcome ON doc_id = page_id GROUP BY host
),
named AS (
  SELECT host, n, good, parts, array_to_string(parts[-2:], '.') AS two,
         regexp_matches(array_to_string(parts, '.'), '^[0-9]+(\\.[0-9]+){{3}}$') AS ip
  FROM bare
),
hosts AS (
  SELECT host, n, good,
         CASE WHEN ip THEN array_to_string(parts, '.') WHEN two IN ({two}) THEN array_to_string(parts[-3:], '.')
              ELSE two END AS domain,
         CASE WHEN ip THEN 'ip' WHEN two IN ({two}) THEN two ELSE parts[-1] END AS suffix
  FROM named
),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY suffix, domain),
suffix_priors AS (
  SELECT suffix, sum(n) AS n, sum(good) AS good,
         (SELECT (sum(good) + 1.0) / (sum(n) + 2.0) FROM hosts) AS prior
  FROM domains GROUP BY suffix
),
suffixes AS (SELECT suffix, (k * prior + good) / (k + n) AS mean FROM suffix_priors, (SELECT {_strength('suffix_priors')} AS k)),
domain_priors AS (SELECT suffix, domain, n, good, mean AS prior FROM domains JOIN suffixes USING (suffix)),
domain_means AS (SELECT suffix, domain, (k * prior + good) / (k + n) AS mean FROM domain_priors, (SELECT {_strength('domain_priors')} AS k)),
host_priors AS (SELECT host, n, good, mean AS prior FROM hosts JOIN domain_means USING (suffix, domain)),
host_means AS (
  SELECT host, (k * prior + good) / (k + n) AS mean, k + n + 1 AS size
  FROM host_priors, (SELECT {_strength('host_priors')} AS k)
),
scores AS (SELECT host, mean, mean + 1.6448536269514722 * sqrt(mean * (1 - mean) / size) AS upper FROM host_means)
SELECT page_id, host, path, {name} AS rule,
       coalesce({action}, CASE WHEN upper < 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
       round(mean, 6) AS host_mean, round(upper, 6) AS host_upper
FROM page LEFT JOIN scores USING (host)"""


def licence_sentences() -> str:
    known = ", ".join(
        f"({_quoted(licenses._normalise(s))}, {_quoted(i)})" for i, s in licenses.SENTENCES.items()
    )
    left, columns, names = "',' || ids || ','", [], list(dict.fromkeys(n for n, _ in licenses.RULES))
    hits: dict[str, list[str]] = {n: [] for n in names}
    for name, sequence in licenses.RULES:
        part = _quoted("".join(f",{x}," for x in sequence))
        hits[name].append(f"contains({left}, {part})")
        left = f"replace({left}, {part}, '')"
    other = " OR ".join(x for n, h in hits.items() if n not in licenses.ONLY_ALONE for x in h)
    when = lambda n, h: f"({' OR '.join(h)})" + (f" AND NOT ({other})" if n in licenses.ONLY_ALONE else "")
    columns = ", ".join(f"CASE WHEN {when(n, h)} THEN {_quoted(n)} END" for n, h in hits.items())
    return f"""
WITH known(sentence, sentence_id) AS (SELECT DISTINCT * FROM (VALUES {known})),
plain AS (
  SELECT row_number() OVER () AS rowid_, doc_id,
         regexp_replace(regexp_replace(lower(text), '[^a-z0-9.!?;\\n]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g') AS t
  FROM documents
),
read_ AS (
  SELECT rowid_, doc_id, 1 AS reading, t FROM plain
  UNION ALL
  SELECT rowid_, doc_id, 2, regexp_replace(regexp_replace(regexp_replace(t, '\\n\\n+', chr(1), 'g'), '\\n', ' ', 'g'), chr(1), chr(10), 'g')
  FROM plain
),
cut AS (SELECT *, string_split(regexp_replace(t, '[.!?;:]+( |\\n|\\z)', chr(10), 'g'), chr(10)) AS parts FROM read_),
lines AS (
  SELECT rowid_, doc_id, reading, trim(unnest(parts)) AS line, generate_subscripts(parts, 1) AS i FROM cut
),
placed AS (
  SELECT rowid_, doc_id, line,
         sum(CASE WHEN line = '' THEN 0 ELSE len(line) - len(replace(line, ' ', '')) + 1 END) OVER (
           PARTITION BY rowid_, reading ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS place
  FROM lines
),
found AS (
  SELECT doc_id, string_agg(sentence_id, ',,' ORDER BY place, sentence_id) AS ids, count(*) AS n_sentences
  FROM (SELECT DISTINCT rowid_, doc_id, coalesce(place, 0) AS place, sentence_id FROM placed JOIN known ON line = sentence)
  GROUP BY rowid_, doc_id
)
SELECT doc_id, concat_ws(',', {columns}) AS licenses, replace(ids, ',,', ',') AS sentence_ids, n_sentences FROM found"""


PAGE_ARCHIVES = """
WITH payload AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
),
digests AS (
  SELECT page_id, payload_bytes, hex,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (
           (CAST('0x' || substr(hex, 1 + 10 * (i // 8), 10) AS BIGINT) >> (5 * (7 - i % 8))) & 31) AS INTEGER), 1)), '')
           AS payload_digest
  FROM payload
),
first AS (SELECT hex, max(page_id) AS first FROM digests GROUP BY hex)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM digests JOIN first USING (hex)"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM words WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * c >= 80 * (p.n + q.n - c)
),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) r ON r.x = d.doc_id"""

REPEATED_WINDOWS = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words WHERE len(w) >= 20)
),
firsts AS (SELECT s, min((doc_id, i)) AS f FROM windows GROUP BY s HAVING count(*) > 1),
covered AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM windows JOIN firsts USING (s) WHERE (doc_id, i) <> f
),
gone AS (SELECT doc_id, count(*) AS n_removed FROM covered GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t
  FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words) ANTI JOIN covered USING (doc_id, i)
  GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)"""

COLLOCATIONS = f"""
WITH pieces AS (
  SELECT lang, piece, regexp_extract_all(t, '[^\\x20\\x09]+') AS w
  FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS t, row_number() OVER () AS piece
        FROM (SELECT coalesce(lang, 'und') AS lang, {_LOWER.format("coalesce(text, '')")} AS t FROM documents))
),
totals AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces), range(1, 6) AS sizes(m) WHERE i + m - 1 <= len(w)
),
counts AS (SELECT lang, phrase, m, CAST(count(*) AS HUGEINT) AS f FROM grams GROUP BY lang, phrase, m HAVING count(*) >= 100),
split AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE m >= 2),
absorbed AS (
  SELECT DISTINCT g.lang, array_to_string(g.w[i:i + k - 1], ' ') AS phrase
  FROM split g, range(1, 5) AS starts(i), range(2, 5) AS sizes(k), counts c
  WHERE k < g.m AND i + k - 1 <= g.m AND c.lang = g.lang AND c.phrase = array_to_string(g.w[i:i + k - 1], ' ') AND 100 * g.f >= 100 * c.f
),
cuts AS (
  SELECT s.lang, s.phrase, s.f AS a, l.f AS l, r.f AS r, n, (1000 * s.f * n) // (l.f * r.f) AS score, k
  FROM split s JOIN totals USING (lang), range(1, 5) AS places(k), counts l, counts r
  WHERE k < s.m AND l.lang = s.lang AND l.phrase = array_to_string(s.w[1:k], ' ')
    AND r.lang = s.lang AND r.phrase = array_to_string(s.w[k + 1:s.m], ' ')
),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
  FROM worst ANTI JOIN absorbed USING (lang, phrase)
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000"""
