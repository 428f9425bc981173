"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from quarrystone.llm import reshard, urls
from quarrystone.llm.decontaminate import EXTEND, MASKS, MIN_SHARE, SHORTEST, short_masks
from quarrystone.llm.katz import CUT, FOLDS, SCALE

_WORDS = r"regexp_extract_all(lower(text), '(?:[a-z0-9]|[^\x00-\x7F])+')"


def _decontaminate() -> str:
    span = max(map(len, MASKS))
    keep = lambda m, i: ", ".join(f"w[{i} + {k}]" for k, b in enumerate(m) if b == "1")
    seeds = []
    for n, m in enumerate(MASKS):
        seeds.append(f"SELECT {n} AS mask, {len(m)} AS wide, id, item, i, [{keep(m, 'i')}] AS seed FROM p WHERE i + {len(m) - 1} <= n AND (NOT item OR n >= {span})")
    for n in range(SHORTEST, span):
        for k, m in enumerate(short_masks(n)):
            seeds.append(f"SELECT {100 * n + k} AS mask, {n} AS wide, id, item, i, [{keep(m, 'i')}] AS seed FROM p JOIN short s ON s.n = {n} WHERE i + {n - 1} <= p.n AND (NOT item OR p.n = {n})")
    return f"""
WITH d AS (SELECT DISTINCT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark),
t AS (SELECT doc_id AS id, false AS item, w, len(w) AS n FROM d UNION ALL SELECT item_id, true, w, len(w) FROM b),
p AS (SELECT id, item, w, n, unnest(range(1, n + 1)) AS i FROM t WHERE n > 0),
short AS (SELECT DISTINCT n FROM t WHERE item AND n < {span}),
seeds AS ({' UNION ALL '.join(seeds)}),
hits AS (SELECT DISTINCT x.id AS doc_id, y.id AS item_id, x.i AS p, y.i AS q, x.wide FROM seeds x JOIN seeds y ON NOT x.item AND y.item AND x.mask = y.mask AND x.seed = y.seed),
spans AS (SELECT h.doc_id, h.item_id, d.w AS dw, b.w AS bw, p - back AS ds, q - back AS qs, wide + back + ahead AS n FROM (
  SELECT h.*, least({EXTEND}, p - 1, q - 1) AS back, least({EXTEND}, len(d.w) - p - wide + 1, len(b.w) - q - wide + 1) AS ahead
  FROM hits h JOIN d ON d.doc_id = h.doc_id JOIN b ON b.item_id = h.item_id) h JOIN d ON d.doc_id = h.doc_id JOIN b ON b.item_id = h.item_id),
scored AS (SELECT doc_id, item_id, ds - 1 AS doc_start, qs - 1 AS item_start, n AS n_words, len(list_filter(range(0, n), lambda k: dw[ds + k] = bw[qs + k])) AS n_agree FROM spans)
SELECT doc_id, item_id, doc_start, item_start, n_words, n_agree FROM scored WHERE n_agree >= {MIN_SHARE} * n_words
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_agree DESC, doc_start, item_start, n_words DESC) = 1
"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _normal(u: str) -> str:
    u = f"trim({u}, ' ')"
    part = lambda g: f"regexp_extract({u}, {_quoted(urls._PARTS)}, {g})"
    host = f"regexp_replace(regexp_replace(lower({part(1)}), ':(80|443)?$', ''), '^(www|m)[.]', '')"
    kept = f"array_to_string(list_sort(list_filter(string_split(substr({part(3)}, 2), '&'), lambda x: x <> '' AND NOT regexp_matches(x, {_quoted(urls.TRACKING)}))), '&')"
    full = f"'https://' || {host} || regexp_replace({part(2)}, '/+$', '') || CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END"
    return f"(CASE WHEN {u} = '' THEN NULL WHEN regexp_matches({u}, {_quoted(urls._PARTS)}) THEN {full} ELSE {u} END)"


def _urls() -> str:
    site, folder = "regexp_extract(trim(url, ' '), '^([A-Za-z]+://[^/?#]*)', 1)", "regexp_extract(trim(url, ' '), '^([A-Za-z]+://[^?#]*/)[^/?#]*', 1)"
    link = f"""CASE WHEN l = '' THEN NULL WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN l WHEN starts_with(l, '//') THEN 'https:' || l
      WHEN starts_with(l, '/') THEN {site} || l WHEN length({folder}) > length({site}) THEN {folder} || l ELSE {site} || '/' || l END"""

    def rules(rows: tuple[tuple[str, str], ...]) -> str:
        host = f"regexp_extract(form, {_quoted(urls._PARTS)}, 1)"
        path = "regexp_replace(form, '[?].*$', '')"
        tests = []
        for kind, value in rows:
            v = _quoted(value)
            tests.append(f"({host} = {v} OR ends_with({host}, '.' || {v}))" if kind == "host" else f"({path} = {_normal(v)} OR starts_with({path}, {_normal(v)} || '/'))" if kind == "prefix" else f"form = {_normal(v)}")
        return " OR ".join(tests)

    return f"""
WITH RECURSIVE links AS (SELECT url, unnest([regexp_extract(regexp_extract(html, {_quoted(urls._CANONICAL)}, 1), {_quoted(urls._HREF)}, 1), regexp_extract(html, {_quoted(urls._REFRESH)}, 1)]) AS l FROM pages),
e AS (SELECT {_normal('url')} AS a, {_normal('(' + link + ')')} AS b FROM links),
sym AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach AS (SELECT a AS n, a AS m FROM sym UNION SELECT r.n, s.b FROM reach r JOIN sym s ON s.a = r.m),
groups AS (SELECT n, min(m) AS class FROM reach GROUP BY n),
p AS (SELECT page_id, url, {_normal('url')} AS form FROM pages),
forms AS (SELECT form FROM p WHERE form IS NOT NULL UNION SELECT n FROM groups),
marked AS (SELECT form, coalesce(class, form) AS class, ({rules(urls.ALLOWED)}) AS ok, ({rules(urls.BLOCKED)}) AS bad FROM forms LEFT JOIN groups ON n = form),
hit AS (SELECT DISTINCT class FROM marked WHERE bad AND NOT ok),
named AS (SELECT form, m.class, CASE WHEN ok THEN 'allow rule' WHEN bad THEN 'block rule' WHEN h.class IS NOT NULL THEN 'alias of blocked' ELSE 'none' END AS reason FROM marked m LEFT JOIN hit h ON h.class = m.class)
SELECT page_id, url, p.form, class, CASE coalesce(reason, 'none') WHEN 'allow rule' THEN 'allow' WHEN 'none' THEN 'keep' ELSE 'block' END AS decision, coalesce(reason, 'none') AS reason
FROM p LEFT JOIN named ON named.form = p.form
"""


def _katz() -> str:
    ratio = lambda r: f"(({r + 1}.0 * n{r + 1} / ({r} * n{r}) - a) / (1 - a))"
    level = lambda r: f"CASE WHEN a < 1 AND n{r} > 0 AND n{r + 1} > 0 AND {ratio(r)} > 0 AND {ratio(r)} <= 1 THEN {ratio(r)} ELSE 1.0 END::DOUBLE"
    numbers = ", ".join(f"count(*) FILTER (c = {r})::DOUBLE AS n{r}" for r in range(1, CUT + 2))

    def kept(n: int) -> str:
        """Discounts of an order in each fold's model, and the n-grams' counts with them."""
        key = ", ".join("uvw"[3 - n :])
        return f"""n{n} AS (SELECT m, {numbers} FROM c{n} GROUP BY m),
k{n} AS (SELECT m, [{', '.join(level(r) for r in range(1, CUT + 1))}] AS d FROM (SELECT *, CASE WHEN n1 > 0 THEN {CUT + 1}.0 * n{CUT + 1} / n1 ELSE 1.0 END AS a FROM n{n})),
x{n} AS (SELECT c{n}.m, {key}, c, CASE WHEN c <= {CUT} THEN d[c] ELSE 1.0 END::DOUBLE AS d FROM c{n} JOIN k{n} ON k{n}.m = c{n}.m)"""

    return f"""
WITH t AS (SELECT doc_id, coalesce((((doc_id % 1048576 + 1048576) % 1048576) * 40503 // 1024) % {FOLDS}, 0) AS f, list_concat(list_concat(['<s>', '<s>'], {_WORDS}), ['</s>']) AS t FROM documents WHERE text IS NOT NULL),
o AS (SELECT doc_id, f, unnest(t[1 : len(t) - 2]) AS u, unnest(t[2 : len(t) - 1]) AS v, unnest(t[3 : len(t)]) AS w FROM t),
s AS (SELECT f, u, v, w, count(*) AS c FROM o GROUP BY ALL),
c3 AS (SELECT m, u, v, w, sum(c)::BIGINT AS c FROM s JOIN range({FOLDS}) r(m) ON m <> f GROUP BY ALL),
c2 AS (SELECT m, v, w, sum(c)::BIGINT AS c FROM c3 GROUP BY ALL),
c1 AS (SELECT m, w, sum(c)::BIGINT AS c FROM c3 GROUP BY ALL),
{kept(1)},
{kept(2)},
{kept(3)},
h1 AS (SELECT m, sum(c) AS total, sum((1 - d) * c) AS cut FROM x1 GROUP BY m),
z1 AS (SELECT m, CASE WHEN cut > 0 THEN total ELSE total + 1 END AS own, CASE WHEN cut > 0 THEN cut / total ELSE 1.0 / (total + 1) END AS never FROM h1),
p1 AS (SELECT x1.m, w, d * c / own AS p FROM x1 JOIN z1 ON z1.m = x1.m),
h2 AS (SELECT m, v, sum(c) + CASE WHEN bool_or(d < 1) THEN 0 ELSE 1 END AS own, sum(d * c) AS mass FROM x2 GROUP BY m, v),
b2 AS (SELECT x2.m, x2.v, any_value((1 - mass / own)) / (1 - sum(p1.p)) AS alpha FROM x2 JOIN h2 ON h2.m = x2.m AND h2.v = x2.v JOIN p1 ON p1.m = x2.m AND p1.w = x2.w GROUP BY x2.m, x2.v),
p2 AS (SELECT x2.m, x2.v, w, d * c / own AS p FROM x2 JOIN h2 ON h2.m = x2.m AND h2.v = x2.v),
h3 AS (SELECT m, u, v, sum(c) + CASE WHEN bool_or(d < 1) THEN 0 ELSE 1 END AS own, sum(d * c) AS mass FROM x3 GROUP BY m, u, v),
b3 AS (SELECT x3.m, x3.u, x3.v, any_value((1 - mass / own)) / (1 - sum(p2.p)) AS alpha FROM x3 JOIN h3 ON h3.m = x3.m AND h3.u = x3.u AND h3.v = x3.v JOIN p2 ON p2.m = x3.m AND p2.v = x3.v AND p2.w = x3.w GROUP BY x3.m, x3.u, x3.v),
p3 AS (SELECT x3.m, x3.u, x3.v, w, d * c / own AS p FROM x3 JOIN h3 ON h3.m = x3.m AND h3.u = x3.u AND h3.v = x3.v),
l AS (SELECT s.f, s.u, s.v, s.w, ln(CASE WHEN p3.p IS NOT NULL THEN p3.p ELSE coalesce(b3.alpha, 1) * CASE WHEN p2.p IS NOT NULL THEN p2.p ELSE coalesce(b2.alpha, 1) * coalesce(p1.p, never, 1) END END) AS lp
  FROM s LEFT JOIN p3 ON p3.m = f AND p3.u = s.u AND p3.v = s.v AND p3.w = s.w LEFT JOIN b3 ON b3.m = f AND b3.u = s.u AND b3.v = s.v
  LEFT JOIN p2 ON p2.m = f AND p2.v = s.v AND p2.w = s.w LEFT JOIN b2 ON b2.m = f AND b2.v = s.v LEFT JOIN p1 ON p1.m = f AND p1.w = s.w LEFT JOIN z1 ON z1.m = f)
SELECT doc_id, count(*) AS n_tokens, round(sum(round(lp * {SCALE})::BIGINT) / {SCALE}, 4) AS logprob, round(sum(round(lp * {SCALE})::BIGINT) / {SCALE} / count(*), 4) AS mean_logprob
FROM o JOIN l ON l.f = o.f AND l.u = o.u AND l.v = o.v AND l.w = o.w WHERE doc_id IS NOT NULL GROUP BY doc_id
"""


def _reshard() -> str:
    n = reshard.NEW_SHARDS
    return f"""
WITH raw AS (SELECT doc_id, source, coalesce(strlen(text), 0) + 1 AS n_bytes FROM documents),
sizes AS (SELECT source, sum(n_bytes)::BIGINT AS size, (sum(sum(n_bytes)) OVER ())::BIGINT AS total FROM raw GROUP BY source),
counts AS (SELECT source, size, total, greatest(1, least({reshard.MAX_BLOCK}, total // {n * reshard.BLOCKS})) AS bytes FROM sizes),
d AS (SELECT doc_id, raw.source, n_bytes, ((doc_id % k) + k) % k AS blk FROM raw JOIN (SELECT source AS s, (size + bytes - 1) // bytes AS k FROM counts) ON s IS NOT DISTINCT FROM raw.source),
blocks AS (SELECT source, blk, sum(n_bytes)::BIGINT AS size FROM d GROUP BY ALL),
olds AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, size FROM sizes),
news AS (SELECT j, (total * (j + 1)) // {n} - (total * j) // {n} AS cap FROM range({n}) r(j), (SELECT max(total) AS total FROM sizes)),
paired AS (SELECT coalesce(i, j) AS k, source, coalesce(size, 0) AS size, coalesce(cap, 0) AS cap, CASE WHEN i IS NULL OR j IS NULL THEN 0 ELSE least(size, cap) END AS stay FROM olds FULL JOIN news ON i = j),
flow AS (SELECT *, coalesce(sum(size - stay) OVER w, 0)::BIGINT AS gave, coalesce(sum(cap - stay) OVER w, 0)::BIGINT AS got FROM paired WINDOW w AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
mid AS (SELECT b.source, b.blk, f.k, 2 * coalesce(sum(b.size) OVER (PARTITION BY b.source ORDER BY b.blk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + b.size AS m, f.stay, f.gave FROM blocks b JOIN flow f ON f.k = (SELECT o.i FROM olds o WHERE o.source IS NOT DISTINCT FROM b.source)),
goal AS (SELECT m.source, m.blk, m.k, CASE WHEN m.m < 2 * m.stay THEN m.k ELSE (SELECT min(f.k) FROM flow f WHERE m.m - 2 * m.stay + 2 * m.gave < 2 * (f.got + f.cap - f.stay) AND f.cap > f.stay) END AS j FROM mid m)
SELECT doc_id, d.source AS old_shard, j::INTEGER AS new_shard, n_bytes, j <> k AS moved FROM d JOIN goal g ON g.source IS NOT DISTINCT FROM d.source AND g.blk = d.blk
"""


SQL: dict[str, str] = {"op1_url_filter": _urls(), "op4_katz": _katz(), "op5_reshard": _reshard(), "op7_decontaminate": _decontaminate()}
