"""The same results as SQL for DuckDB, where SQL can express them."""

from __future__ import annotations

from varstrata.llm import licenses, quality, sharding, urls

WS = r"[\x20\x09-\x0D]+"


def quality_metrics(docs: str = "documents") -> str:
    """CTEs that end in metrics: one row per document with the base counts and the metrics."""
    return rf"""
texts AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM {docs}),
ws AS (SELECT *, list_filter(regexp_split_to_array(t, '{WS}'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM texts),
win AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM ws WHERE len(w) >= 3)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
counts AS (SELECT ws.rid, doc_id, lang, source, len(w)::BIGINT AS n_words,
  length(regexp_replace(t, '{WS}', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_upper,
  (length(t) - length(replace(t, '!', '')))::BIGINT AS n_bangs
  FROM ws LEFT JOIN rep ON ws.rid = rep.rid),
metrics AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
  (1000 * n_symbols) // greatest(word_chars, 1) AS symbol_share, (1000 * n_upper) // greatest(word_chars, 1) AS upper_share,
  (1000 * n_bangs) // greatest(word_chars, 1) AS bang_share, (1000 * n_repeat_words) // greatest(n_words, 1) AS repeat_share,
  (10 * word_chars) // greatest(n_words, 1) AS word_len FROM counts)"""


def quality_cuts() -> str:
    """CTEs after metrics that end in judged: fences per language, source and metric, and every document's verdict."""
    cols = ", ".join(quality.METRICS)
    spec = ", ".join(f"('{k}', {'NULL' if low is None else low}, {high})" for k, (low, high) in quality.METRICS.items())
    weight = lambda n: f"({n} * {1000 * quality.PRIOR}) // (sum({n}) OVER (PARTITION BY lang, source, metric))::BIGINT"
    width = lambda b: f"(1::BIGINT << greatest(length(bin({b})) - 6, 0))"
    cut = lambda q, name: f"min(b) FILTER (100 * below >= {q} * total) AS {name}"
    return f"""
long AS (SELECT lang, source, metric, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS b, count(*) AS n
  FROM (UNPIVOT (SELECT lang, source, {cols} FROM metrics WHERE NOT base_failed) ON {cols} INTO NAME metric VALUE v) GROUP BY ALL),
gs AS (SELECT DISTINCT lang, source, metric FROM long),
la AS (SELECT lang, metric, b, sum(n)::BIGINT AS n FROM long GROUP BY ALL), al AS (SELECT metric, b, sum(n)::BIGINT AS n FROM long GROUP BY ALL),
blend AS (SELECT lang, source, metric, b, 1000 * n AS w FROM long
  UNION ALL SELECT g.lang, g.source, g.metric, b, {weight("n")} FROM (SELECT g.lang, g.source, g.metric, b, n FROM gs g JOIN la ON g.lang IS NOT DISTINCT FROM la.lang AND g.metric = la.metric) g
  UNION ALL SELECT g.lang, g.source, g.metric, b, {weight("n")} FROM (SELECT g.lang, g.source, g.metric, b, n FROM gs g JOIN al ON g.metric = al.metric) g),
run AS (SELECT lang, source, metric, b, sum(w) OVER (PARTITION BY lang, source, metric ORDER BY b) AS below, sum(w) OVER (PARTITION BY lang, source, metric) AS total FROM blend),
spec(metric, p_low, p_high) AS (VALUES {spec}),
quant AS (SELECT lang, source, metric, {cut("p_low", "low")}, {cut(quality.MIDDLE, "mid")}, {cut("p_high", "high")} FROM run JOIN spec USING (metric) GROUP BY ALL),
cuts AS (SELECT lang, source, metric, high + greatest({quality.SPREADS} * (high - mid), {width("high")}) AS hi,
  low - greatest({quality.SPREADS} * (mid - low), {width("low")}) AS lo FROM quant),
flat AS (SELECT rid, lang, source, metric, v FROM (UNPIVOT (SELECT rid, lang, source, {cols} FROM metrics) ON {cols} INTO NAME metric VALUE v)),
bad AS (SELECT DISTINCT rid FROM flat JOIN cuts ON flat.lang IS NOT DISTINCT FROM cuts.lang AND flat.source IS NOT DISTINCT FROM cuts.source
  AND flat.metric = cuts.metric WHERE v > hi OR v < lo),
judged AS (SELECT m.*, NOT base_failed AND bad.rid IS NULL AS kept FROM metrics m LEFT JOIN bad ON m.rid = bad.rid)"""


def op1() -> str:
    cols = ", ".join(quality.METRICS)
    return f"WITH {quality_metrics()}, {quality_cuts()} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, {cols} FROM judged"


def op3() -> str:
    slots = sharding.lookup()
    return f"""WITH place AS (SELECT {slots}::INTEGER[] AS slots, {list(sharding.SHARDS)}::VARCHAR[] AS names),
k AS (SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {len(slots)})::INTEGER AS slot FROM documents)
SELECT doc_id, slot, names[slots[slot + 1] + 1] AS shard FROM k, place"""


def op5() -> str:
    text = lambda x: x.decode() if isinstance(x, bytes) else x
    phrases = ", ".join(f"({p.split()}, '{label}')" for p, label in licenses.PHRASES.items())
    templates = ", ".join(f"({k}, {sorted({text(w) for w in licenses.words(t)})}, '{label}', {-(-5 * len(licenses.words(t)) // 4)})" for k, (label, t) in enumerate(licenses.TEMPLATES))
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p(pw, label) AS (VALUES {phrases}), tpl(tid, tw, label, span) AS (VALUES {templates}),
ws AS (SELECT *, regexp_extract_all(t, '{word}') AS w FROM docs),
spots AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM ws),
places AS (SELECT rid, i - 1 AS pos, label FROM spots, p WHERE list_slice(w, i, i + len(pw) - 1) = pw),
base AS (SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY rid),
ls AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM docs),
bl AS (SELECT row_number() OVER () AS bid, rid, list_distinct(regexp_extract_all(line, '{word}')) AS bw FROM ls),
lined AS (SELECT bid, rid, tid, label, len(list_intersect(bw, tw)) AS s, len(tw) AS n FROM bl, tpl WHERE 100 * len(list_intersect(bw, tw)) >= {licenses.CONTAINMENT} * len(tw)),
near AS (SELECT rid, tid, label, w, tw, span FROM ws, tpl WHERE 100 * len(list_intersect(w, tw)) >= {licenses.CONTAINMENT} * len(tw)),
windows AS (SELECT rid, tid, label, max(len(list_intersect(list_slice(w, i, i + span - 1), tw))) AS s, max(len(tw)) AS n FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM near) GROUP BY ALL HAVING 100 * max(len(list_intersect(list_slice(w, i, i + span - 1), tw))) >= {licenses.CONTAINMENT} * max(len(tw))),
hits AS (SELECT rid, label, s, n, bid AS block FROM lined UNION ALL SELECT w.rid, w.label, w.s, w.n, -1 - w.tid FROM windows w WHERE NOT EXISTS (SELECT 1 FROM lined l WHERE l.rid = w.rid AND l.tid = w.tid)
  UNION ALL SELECT w.rid, w.label, w.s, w.n, NULL FROM windows w),
found AS (SELECT rid, max(s / n) AS score, count(DISTINCT block) AS n_blocks FROM hits GROUP BY rid),
every AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM hits UNION ALL SELECT rid, label FROM places) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0)::DOUBLE END AS score, coalesce(n_blocks, 0) AS n_blocks
FROM ws LEFT JOIN base ON ws.rid = base.rid LEFT JOIN found ON ws.rid = found.rid LEFT JOIN every ON ws.rid = every.rid"""


def op7() -> str:
    weights, bias = urls.train()
    name, said = "NULL", "NULL"
    for verdict, h, p in sorted(urls.RULES, key=lambda r: len(r[1] + r[2])):
        fits = f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
        name, said = f"CASE WHEN {fits} THEN '{h}{p}' ELSE {name} END", f"CASE WHEN {fits} THEN '{verdict}' ELSE {said} END"
    grams = lambda c, salt: f"list_transform(range(1, greatest(length({c}), 0) + 1), lambda i: ((({urls.MIX}::BIGINT * (unicode(('^' || {c} || '$')[i]) * 961 + unicode(('^' || {c} || '$')[i + 1]) * 31 + unicode(('^' || {c} || '$')[i + 2]) + {salt})) >> 4) % {urls.DIM}))"
    return rf"""WITH model AS (SELECT {weights}::BIGINT[] AS w),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
f AS (SELECT *, list_concat({grams("host", urls.HOST_SALT)}, {grams("path", urls.PATH_SALT)}) AS f FROM parts),
scored AS (SELECT *, (coalesce(list_sum(list_transform(f, lambda k: w[k + 1])), 0) + {bias} * len(f))::BIGINT AS margin FROM f, model)
SELECT page_id, host, path, {name} AS rule, coalesce({said}, CASE WHEN margin > 0 THEN 'block' ELSE 'allow' END) AS verdict, margin FROM scored"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": op1(), "op3_sharding": op3(), "op5_license_scans": op5(), "op7_url_filters": op7()}
