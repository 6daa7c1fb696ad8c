"""Check SQL (DuckDB) of the text queries that SQL can express."""

from __future__ import annotations

from tickframe.llm.hostquality import FEATURES as BIN_FEATURES
from tickframe.llm.hostquality import LEAST_PRIOR, MOST_PRIOR, SMOOTH, bin_sql
from tickframe.llm.rules import ROUNDS, RULES, START_GOOD, START_RIGHT, WINDOW
from tickframe.llm.urlfilter import DEPTH, FOLDS, PRIOR, RATE, RIDGE, SAMPLE, TREES
from tickframe.llm.urlfilter import FEATURES as URL_FEATURES

_WORD = r"[^\x20\x09-\x0D]+"


def _left(pattern: str) -> str:
    return f"length(regexp_replace(t, '{pattern}', '', 'g'))"


#: The counts that rules read, one row a document of ``documents``.
FEATURES = rf"""
body AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
spans AS (SELECT doc_id, unnest(range(1, len(w) - {WINDOW - 2})) AS i, w FROM body WHERE len(w) >= {WINDOW}),
named AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM spans),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM named) WHERE n > 1),
covered AS (SELECT doc_id, sum(least({WINDOW}, step)) AS n FROM (
  SELECT doc_id, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), {WINDOW}) AS step FROM twice) GROUP BY doc_id),
lined AS (SELECT doc_id, t, w, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '{_WORD}')] AS lines FROM body),
features AS (
  SELECT l.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {_left('[^#*$%&|<>]+')} AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    len(lines) AS n_lines, {_left('[^A-Z]+')} AS n_capitals, {_left('[^!]+')} AS n_shouts, {_left(r'[^\p{L}]+')} AS n_letters,
    len(regexp_extract_all(t, '(^|[\x20\x09-\x0D])[^\p{{L}}\p{{N}}\x20\x09-\x0D]')) AS n_odd_starts,
    len(regexp_extract_all(t, '[!#$%&*]{{2,}}')) AS n_runs
  FROM lined l LEFT JOIN covered c ON c.doc_id = l.doc_id)"""

_VOTES = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END" for _, bad, good in RULES)
_ODDS = "ln(good / (1 - good))" + "".join(
    f" + CASE WHEN v[{j}] > 0 THEN ln(g[{j}] / (1 - b[{j}])) WHEN v[{j}] < 0 THEN ln((1 - g[{j}]) / b[{j}]) ELSE 0 END"
    for j in range(1, len(RULES) + 1))


def _rates(start: float, share: str, right: str) -> str:
    return "[" + ", ".join(f"({start} + sum(CASE WHEN v[{j}] {right} 0 THEN {share} ELSE 0 END)) / (1.0 + sum(CASE WHEN v[{j}] <> 0 "
                           f"THEN {share} ELSE 0 END))" for j in range(1, len(RULES) + 1)) + "]"


def _rounds() -> str:
    """Expectation and maximisation, written out round by round."""
    same = lambda x: "[" + ", ".join([f"CAST({x} AS DOUBLE)"] * len(RULES)) + "]"
    text = f"em0 AS (SELECT CAST({START_GOOD} AS DOUBLE) AS good, {same(START_RIGHT[0])} AS g, {same(START_RIGHT[1])} AS b)"
    for k in range(ROUNDS):
        text += f""",
p{k} AS MATERIALIZED (SELECT v, n, 1 / (1 + exp(-({_ODDS}))) AS p FROM patterns, em{k}),
em{k + 1} AS MATERIALIZED (SELECT (sum(p * n) + 1) / (sum(n) + 2) AS good, {_rates(START_RIGHT[0], 'p * n', '>')} AS g,
  {_rates(START_RIGHT[1], '(1 - p) * n', '<')} AS b FROM p{k})"""
    return text


QUALITY_RULES = f"""WITH {FEATURES},
voted AS (SELECT *, [{_VOTES}] AS v, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM features),
patterns AS MATERIALIZED (SELECT v, CAST(count(*) AS DOUBLE) AS n FROM voted WHERE n_words > 0 GROUP BY v),
{_rounds()}
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND p >= 0.5 AS kept, round(p, 6) AS p_good
FROM (SELECT *, 1 / (1 + exp(-({_ODDS}))) AS p FROM voted, em{ROUNDS})"""

_BINS = ", ".join(f"{bin_sql(over, under, bounds)} AS bin_{name}" for name, over, under, bounds in BIN_FEATURES)


def _evidence(name: str, size: int) -> str:
    return (f"ln((coalesce(c_{name}.good, 0) + {SMOOTH}) / (whole.k + {SMOOTH * size})) "
            f"- ln((coalesce(c_{name}.n - c_{name}.good, 0) + {SMOOTH}) / (whole.n - whole.k + {SMOOTH * size}))")


def _worth(groups: str) -> str:
    """Pseudo-labels that the parent of the groups (k of n good) is worth."""
    return f"""(SELECT CASE WHEN total IS NULL OR g < 2 THEN {MOST_PRIOR}
    WHEN within <= 0 OR room <= 0 THEN {MOST_PRIOR} WHEN rho <= 1 / (1 + {MOST_PRIOR}) THEN {MOST_PRIOR}
    ELSE greatest({LEAST_PRIOR}, (1 - rho) / rho) END
  FROM (SELECT *, ((kk - total * p * p) / nullif(within, 0) - (g - 1)) / nullif(room, 0) AS rho
    FROM (SELECT *, p * (1 - p) AS within, total - nn / total - (g - 1) AS room
      FROM (SELECT sum(k) / sum(n) AS p, CAST(sum(n) AS DOUBLE) AS total, count(*) AS g, CAST(sum(n * n) AS DOUBLE) AS nn,
              sum(k * k / n) AS kk FROM {groups}))))"""


_SCORED = " + ".join(_evidence(name, len(bounds) + 2) for name, _, _, bounds in BIN_FEATURES)
_CELLS = "".join(f"\n  LEFT JOIN cells c_{name} ON c_{name}.feature = '{name}' AND c_{name}.bin = r.bin_{name}" for name, *_ in BIN_FEATURES)
HOST_QUALITY = f"""WITH {FEATURES},
rows_ AS (SELECT d.source, d.lang, b.* FROM documents d JOIN (SELECT doc_id, {_BINS} FROM features) b ON b.doc_id = d.doc_id),
known AS (SELECT doc_id, CAST(avg(quality) >= 0.5 AS BIGINT) AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
learned AS (SELECT r.*, good FROM rows_ r JOIN known USING (doc_id)),
cells AS ({" UNION ALL ".join(f"SELECT '{name}' AS feature, bin_{name} AS bin, sum(good) AS good, count(*) AS n FROM learned GROUP BY ALL"
                              for name, *_ in BIN_FEATURES)}),
whole AS (SELECT count(*) AS n, coalesce(sum(good), 0) AS k FROM learned),
hosts AS (SELECT source, sum(good) AS k, count(*) AS n FROM learned GROUP BY source),
paths AS (SELECT source, lang, sum(good) AS k, count(*) AS n FROM learned GROUP BY source, lang),
worths AS (SELECT {_worth('hosts')} AS host_worth, {_worth('paths')} AS path_worth, (k + 1) / (n + 2) AS every FROM whole),
scored AS (SELECT r.doc_id, r.source, r.lang, {_SCORED} AS evidence FROM rows_ r CROSS JOIN whole{_CELLS}),
hosted AS (SELECT s.*, CASE WHEN h.n IS NULL THEN every ELSE (h.k + host_worth * every) / (h.n + host_worth) END AS host_rate, path_worth
  FROM scored s CROSS JOIN worths LEFT JOIN hosts h ON h.source IS NOT DISTINCT FROM s.source),
placed AS (SELECT t.*, (coalesce(p.k, 0) + path_worth * host_rate) / (coalesce(p.n, 0) + path_worth) AS path_rate
  FROM hosted t LEFT JOIN paths p ON p.source IS NOT DISTINCT FROM t.source AND p.lang IS NOT DISTINCT FROM t.lang),
judged AS (SELECT *, 1 / (1 + exp(-(ln(path_rate / (1 - path_rate)) + evidence))) AS p FROM placed)
SELECT doc_id, round(host_rate, 6) AS host_rate, round(path_rate, 6) AS path_rate, round(evidence, 6) AS evidence,
  round(p, 6) AS p_quality, p >= 0.5 AS kept FROM judged"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
RANKED_SEARCH = rf"""WITH counted AS (
  SELECT doc_id, term, count(*) AS tf FROM (
    SELECT doc_id, unnest(regexp_extract_all({_LOWERED}, '{_TERM}')) AS term FROM documents) GROUP BY ALL),
sized AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counted GROUP BY doc_id),
whole AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sized),
weighted AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(n_docs) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w
  FROM counted, whole GROUP BY term),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWERED}, '{_TERM}')) AS term FROM benchmark),
scored AS (
  SELECT a.item_id, c.doc_id, CAST(sum(w.w * ((1000000000 * c.tf) // (1000 * c.tf + 8 * (10 + (90 * s.n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked a JOIN counted c USING (term) JOIN weighted w USING (term) JOIN sized s ON s.doc_id = c.doc_id, whole GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""

#: crc32 by its table of 256 remainders, byte by byte; words; near words by what is left when one place is taken out of both.
SPELLING = r"""WITH RECURSIVE bits AS (
  SELECT i, CAST(i AS BIGINT) AS c, 0 AS step FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8),
runs AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
    FROM documents WHERE text IS NOT NULL) WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (
  SELECT run, k, xor(4294967295, list_reduce(
    list_prepend(4294967295, [CAST(('0x' || substr(hexed, 2 * CAST(j AS INTEGER) - 1, 2)) AS BIGINT) FOR j IN range(1, length(hexed) // 2 + 1)]),
    lambda a, b : xor(a >> 8, t[1 + (xor(a, b) & 255)]))) AS h
  FROM (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS hexed FROM runs), crc),
spelled AS (SELECT k, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM spelled WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
holes AS (SELECT word, n, length(word) AS size, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT DISTINCT a.word, b.word AS other, b.n FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.size = b.size AND a.word <> b.word
  UNION SELECT DISTINCT a.word, w.word, w.n FROM holes a JOIN words w ON w.word = a.rest
  UNION SELECT DISTINCT w.word, a.word, a.n FROM holes a JOIN words w ON w.word = a.rest),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS other_n FROM pairs GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form,
    CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
walk AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL SELECT k.word, f.word, f.form FROM walk k JOIN formed f ON f.word = k.next)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM formed f JOIN walk r ON r.word = f.word AND r.next IS NULL"""

def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"


def _share(level: str) -> str:
    """Blocked share among the labelled URLs of the level, those of the row's own fold left out."""
    return (f"""{level}_all AS (SELECT {level}, coalesce(sum(label), 0) AS k, count(label) AS n FROM urls GROUP BY {level}),
{level}_own AS (SELECT {level}, fold, coalesce(sum(label), 0) AS k, count(label) AS n FROM urls WHERE label IS NOT NULL GROUP BY {level}, fold),
{level}_shares AS (
  SELECT u.row, round((a.k - CASE WHEN u.label IS NULL THEN 0 ELSE o.k END + {PRIOR} * overall)
    / (a.n - CASE WHEN u.label IS NULL THEN 0 ELSE o.n END + {PRIOR}), 6) AS {level}_share
  FROM urls u CROSS JOIN whole JOIN {level}_all a ON a.{level} = u.{level} LEFT JOIN {level}_own o ON o.{level} = u.{level} AND o.fold = u.fold)""")


def _url_node(level: int, tree: int) -> str:
    """Node number of a row after ``level`` splits of a tree."""
    return " + ".join(["0"] + [f"CASE WHEN bins[s{tree}_{d}.f] >= s{tree}_{d}.c THEN {1 << d} ELSE 0 END" for d in range(level)])


def _url_trees() -> str:
    cuts = ", ".join(f"({f + 1}, {c})" for f, (_, bounds) in enumerate(URL_FEATURES) for c in range(1, len(bounds) + 1))
    text = f"""cuts AS (SELECT * FROM (VALUES {cuts}) t(f, c)),
m0 AS (SELECT *, ln((sum(k) OVER () + 1) / (sum(n) OVER () - sum(k) OVER () + 1)) AS margin FROM grouped)"""
    for t in range(TREES):
        text += f""",
g{t} AS MATERIALIZED (SELECT bins, k - n * p AS g, n * p * (1 - p) AS h FROM (SELECT *, 1 / (1 + exp(-margin)) AS p FROM m{t}))"""
        for d in range(DEPTH):
            before = "".join(f", s{t}_{e}" for e in range(d))
            text += f""",
c{t}_{d} AS (SELECT {_url_node(d, t)} AS node, e.f, bins[e.f] AS b, g, h FROM g{t}{before}, (SELECT unnest(range(1, {len(URL_FEATURES) + 1})) AS f) e),
w{t}_{d} AS (SELECT f, c, node, sum(g) FILTER (b >= c) AS gr, sum(h) FILTER (b >= c) AS hr, sum(g) FILTER (b < c) AS gl, sum(h) FILTER (b < c) AS hl
  FROM c{t}_{d} JOIN cuts USING (f) GROUP BY ALL),
s{t}_{d} AS MATERIALIZED (SELECT f, c FROM w{t}_{d} GROUP BY ALL ORDER BY round(sum(coalesce(gr * gr / (hr + {RIDGE}), 0) + coalesce(gl * gl / (hl + {RIDGE}), 0)), 9) DESC,
  f, c LIMIT 1)"""
        every = "".join(f", s{t}_{d}" for d in range(DEPTH))
        node = _url_node(DEPTH, t)
        text += f""",
v{t} AS MATERIALIZED (SELECT {node} AS node, {RATE} * sum(g) / (sum(h) + {RIDGE}) AS value FROM g{t}{every} GROUP BY ALL),
m{t + 1} AS MATERIALIZED (SELECT m{t}.bins, k, n, margin + value AS margin FROM m{t}{every} JOIN v{t} ON v{t}.node = {node}),
q{t + 1} AS MATERIALIZED (SELECT q{t}.row, q{t}.bins, margin + coalesce(value, 0) AS margin FROM q{t}{every} LEFT JOIN v{t} ON v{t}.node = {node})"""
    return text


def _url_filter() -> str:
    after = "CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    bins = ", ".join(" + ".join(f"CASE WHEN {name} >= {b} THEN 1 ELSE 0 END" for b in bounds) for name, bounds in URL_FEATURES)
    names = ", ".join(name for name, _ in URL_FEATURES)
    fits = " ".join(f"WHEN {_fits(host, path)} THEN '{host}{path}'" for host, path in (
        ("example.com", "/de/"), ("example.net", "/en/"), ("org", "/fr/"), ("net", "/")))
    return rf"""WITH parts AS (
  SELECT page_id, coalesce(url, '') AS url, translate(regexp_extract({after}, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract({after}, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract({after}, '^[^/?#]*[^?#]*(?:\?([^#]*))?', 1) AS query FROM pages),
ruled AS (SELECT *, CASE {fits} END AS rule FROM parts),
urls AS MATERIALIZED (
  SELECT row_number() OVER () AS row, *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 1 WHEN rule IS NOT NULL THEN 0 END AS label,
    CAST('0x' || substr(md5(url), 1, 8) AS BIGINT) AS digest, CAST('0x' || substr(md5(url), 1, 8) AS BIGINT) % {FOLDS} AS fold,
    string_split(host, '.')[-1] AS last, array_to_string(list_reverse(string_split(host, '.'))[1:2], '.') AS site,
    length(url) AS url_length, length(host) AS host_length, len([x FOR x IN string_split(path, '/') IF x <> '']) AS depth,
    CASE WHEN url = '' THEN 0 ELSE round(length(regexp_replace(url, '[^0-9]+', '', 'g')) / length(url), 6) END AS digit_share,
    CASE WHEN url = '' THEN 0 ELSE round(log2(length(url)) - list_sum([(length(url) - length(replace(url, c, ''))) * log2(length(url) - length(replace(url, c, '')))
      FOR c IN list_distinct(regexp_extract_all(url, '(?s).'))]) / length(url), 6) END AS entropy,
    len([x FOR x IN string_split(query, '&') IF x <> '']) AS n_params, len([x FOR x IN string_split(host, '.') IF x <> '']) AS n_labels,
    length(host) - length(replace(host, '-', '')) AS n_hyphens
  FROM ruled),
whole AS (SELECT (coalesce(sum(label), 0) + 1) / (count(label) + 2) AS overall FROM urls),
{_share('last')},
{_share('site')},
{_share('host')},
featured AS MATERIALIZED (SELECT * FROM urls JOIN last_shares USING (row) JOIN site_shares USING (row) JOIN host_shares USING (row)),
binned AS MATERIALIZED (SELECT row, label, digest, [{bins}] AS bins, {names} FROM featured),
drawn AS (SELECT * FROM binned WHERE label IS NOT NULL ORDER BY digest, label, {names} LIMIT {SAMPLE}),
grouped AS MATERIALIZED (SELECT bins, CAST(sum(label) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM drawn GROUP BY bins),
q0 AS (SELECT row, bins, (SELECT ln((coalesce(sum(k), 0) + 1) / (coalesce(sum(n) - sum(k), 0) + 1)) FROM grouped) AS margin FROM binned),
{_url_trees()}
SELECT page_id, host, path, rule, CASE WHEN label = 1 THEN 'block' WHEN label = 0 THEN 'allow' WHEN p > 0.5 THEN 'block' ELSE 'allow' END AS verdict, round(p, 6) AS p_block
FROM urls JOIN (SELECT row, 1 / (1 + exp(-margin)) AS p FROM q{TREES}) USING (row)"""


URL_FILTER = _url_filter()
