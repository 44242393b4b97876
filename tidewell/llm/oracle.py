"""SQL of the queries, where SQL can say it."""

from __future__ import annotations

from tidewell.llm import filteraudit, hardneg, licenses, quality, secrets

SQL: dict[str, str] = {}

_LIMITS = [("hi", n) for n in quality.METRICS] + [("lo", n) for n, (_, low) in quality.METRICS.items() if low]


def _quality() -> str:
    levels = " ".join(f"WHEN '{m}' THEN {level}" for m, level in quality.UPPER.items())

    def limit(which: str, name: str) -> str:
        least, _ = quality.METRICS[name]
        side = "q3 + " if which == "hi" else "q1 - "
        return f"max(CASE WHEN metric = '{name}' THEN {side}{quality.FENCE} * greatest(q3 - q1, {least}) END) AS {which}_{name}"

    def bounds(table: str, keys: list[str]) -> str:
        by = ", ".join([*keys, "metric"])
        group = f"GROUP BY {', '.join(keys)}" if keys else ""
        return f"""(SELECT {"".join(k + ", " for k in keys)}max(total) AS n, {", ".join(limit(*x) for x in _LIMITS)} FROM (
            SELECT {by}, max(total) AS total, min(bucket) FILTER (upto * 1000 >= total * {quality.LOWER}) AS q1,
                min(bucket) FILTER (upto * 1000 >= total * CASE metric {levels} ELSE {quality.QUARTILE} END) AS q3
            FROM (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}) AS total FROM {table}) GROUP BY {by}) {group})"""

    chosen = ", ".join(
        f"CASE WHEN o.n >= {quality.MIN_GROUP} THEN o.{w}_{n} WHEN l.n >= {quality.MIN_GROUP} THEN l.{w}_{n} ELSE a.{w}_{n} END AS {w}_{n}" for w, n in _LIMITS
    )
    inside = " AND ".join(f"m.{n} <= f.hi_{n}" if w == "hi" else f"m.{n} >= f.lo_{n}" for w, n in _LIMITS)
    permille = {
        "word_length": "word_chars * 1000 // greatest(n_words, 1)", "symbols": "n_symbols * 1000 // greatest(n_words, 1)",
        "dup_lines": "n_dup_lines * 1000 // greatest(n_lines, 1)", "repeats": "n_repeat_words * 1000 // greatest(n_words, 1)",
        "stutter": "n_stutter * 1000 // greatest(n_words, 1)",
    }
    return rf"""
WITH split AS (
    SELECT doc_id, lang, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
        length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols
    FROM documents
),
windows AS (
    SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM split WHERE len(w) >= 8)
),
often AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT doc_id, count(DISTINCT word) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS word FROM often) GROUP BY doc_id),
counts AS (
    SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
        CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
        CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
        CAST(len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS BIGINT) AS n_stutter
    FROM split LEFT JOIN repeated USING (doc_id)
),
m AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {", ".join(f"{v} AS {k}" for k, v in permille.items())} FROM counts
),
pairs AS (
    SELECT lang, source, unnest([{", ".join(f"'{n}'" for n in permille)}]) AS metric, unnest([{", ".join(permille)}]) AS v FROM m WHERE NOT base_failed
),
sketch AS (
    SELECT lang, source, metric, v - v % CAST(2 ** greatest(length(bin(v)) - 7, 0) AS BIGINT) AS bucket, count(*) AS n FROM pairs GROUP BY ALL
),
per_lang AS (SELECT lang, metric, bucket, sum(n) AS n FROM sketch GROUP BY ALL),
overall AS (SELECT metric, bucket, sum(n) AS n FROM per_lang GROUP BY ALL),
f AS (
    SELECT o.lang, o.source, {chosen} FROM {bounds("sketch", ["lang", "source"])} o
    LEFT JOIN {bounds("per_lang", ["lang"])} l ON o.lang IS NOT DISTINCT FROM l.lang CROSS JOIN {bounds("overall", [])} a
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({inside}, false) AS kept,
    {", ".join(f"m.{n} AS {n}_permille" for n in permille)}
FROM m LEFT JOIN f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source
"""


SQL["op1_quality_rules"] = _quality()

SQL["op3_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first_id FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
    array_to_string(flatten(list_transform(range(8), lambda i: list_transform([15, 10, 5, 0], lambda k:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(i * 5 + 1 AS INT), 5) AS BIGINT) >> k) & 31 AS INT) + 1, 1)))), '') AS payload_digest,
    CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

SQL["op5_html_extraction"] = r"""
WITH lines AS (
    SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1), '</?(?:p|h1)>') AS l FROM pages
),
clean AS (
    SELECT page_id, url, list_filter(list_transform(l, lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(
        regexp_replace(x, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM lines
)
SELECT page_id, url, array_to_string(l, chr(10)) AS text, CAST(length(array_to_string(l, chr(10))) AS BIGINT) AS n_chars, CAST(0 AS BIGINT) AS n_template FROM clean
"""

# near-equal sets share one of the rarest shingles of each, so only those are joined; components by walking the links
SQL["op6_near_dedup"] = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
sets AS (
    SELECT doc_id, list_distinct(CASE len(w) WHEN 0 THEN [] WHEN 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words
),
classes AS (SELECT min(doc_id) AS c, len(s) AS n, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY ALL),
items AS (SELECT c, n, unnest(s) AS item FROM classes),
ranked AS (
    SELECT c, n, item, row_number() OVER (PARTITION BY c ORDER BY df, item) AS r
    FROM (SELECT *, count(*) OVER (PARTITION BY item) AS df FROM items)
),
rare AS (SELECT c, n, item FROM ranked WHERE r <= n - (n * 80 + 99) // 100 + 1),
candidates AS (SELECT DISTINCT a.c AS a, b.c AS b FROM rare a JOIN rare b ON a.item = b.item AND a.c < b.c AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80),
links AS (
    SELECT a, b FROM (
        SELECT a, b, x.n + y.n AS total, len(list_intersect(x.s, y.s)) AS shared FROM candidates JOIN classes x ON x.c = a JOIN classes y ON y.c = b
    ) WHERE 100 * shared >= 80 * (total - shared)
),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(c, d) AS (SELECT c, c FROM classes UNION SELECT reach.c, ways.b FROM reach JOIN ways ON reach.d = ways.a),
comps AS (SELECT c, min(d) AS comp FROM reach GROUP BY c)
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(comp, doc_id) AS component_id, doc_id = coalesce(comp, doc_id) AS kept
FROM sets LEFT JOIN classes ON len(sets.s) > 0 AND list_sort(sets.s) = classes.s LEFT JOIN comps USING (c)
"""


def _licenses() -> str:
    quoted = ", ".join("(" + str(i) + ", '" + name + "', '" + text.replace("'", "''") + "')" for i, (name, text) in enumerate(licenses.TEMPLATES))
    def runs(words: str) -> str:
        return f"list_transform(range(1, len({words}) - 3), lambda i: array_to_string({words}[i:i + 4], ' '))"
    return rf"""
WITH templates AS (
    SELECT template, license, list_distinct({runs("w")}) AS s
    FROM (SELECT *, regexp_extract_all(lower(notice), '[a-z0-9]+') AS w FROM (VALUES {quoted}) t(template, license, notice))
),
sized AS (SELECT template, license, len(s) AS n, CAST(2 ** ceil(log2(len(s))) AS BIGINT) AS c, unnest(s) AS item FROM templates WHERE len(s) > 0),
words AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
positions AS (
    SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i + 4], ' ') AS item FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words)
),
hits AS (SELECT doc_id, template, license, n, c, pos, item FROM positions JOIN sized USING (item)),
windows AS (
    SELECT doc_id, template, license, n, q, count(DISTINCT item) AS shared, min(pos) AS first
    FROM (SELECT *, unnest(CASE WHEN pos >= c THEN [pos // c, pos // c - 1] ELSE [pos // c] END) AS q FROM hits) GROUP BY ALL
),
sure AS (SELECT *, shared * 1000 // n AS permille FROM windows WHERE shared * 100 >= n * {licenses.PERCENT})
SELECT doc_id, license, CAST(template AS BIGINT) AS template, max(permille) AS contained_permille, CAST(arg_max(first, permille * 1000000000 - first) AS BIGINT) AS first_word
FROM sure GROUP BY doc_id, license, template
"""


SQL["op8_license_scan"] = _licenses()

def _secrets() -> str:
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def matches(kind: str, pattern: str, group: int = 0, least: int = 0) -> str:
        """Positions are the lengths of what lies between the matches and of the matches, added up."""
        return f"""
    SELECT rid, {secrets.KINDS.index(kind)} AS kind, stop - len AS start, stop FROM (
        SELECT rid, len, g, sum(gap + len) OVER (PARTITION BY rid ORDER BY i) AS stop FROM (
            SELECT rid, i, length(between[i]) AS gap, length(found[i]) AS len, length(grp[i]) AS g FROM (
                SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (
                    SELECT rid, regexp_extract_all(t, {quoted(pattern)}, 0) AS found, regexp_extract_all(t, {quoted(pattern)}, {group}) AS grp,
                        string_split_regex(t, {quoted(pattern)}) AS between FROM docs)))) WHERE g >= {least}"""

    # without look-around: whole runs, of which the end is the key
    run, end = "[A-Za-z0-9+/=]{32,}", "(?:^|=)([A-Za-z0-9+/]{32,}={0,2})$"
    key = f"""
    SELECT rid, {secrets.KINDS.index("key")} AS kind, stop - length(k) AS start, stop FROM (
        SELECT rid, regexp_extract(substr(t, CAST(start + 1 AS BIGINT), CAST(stop - start AS BIGINT)), '{end}', 1) AS k, stop
        FROM ({matches("key", run)}) JOIN docs USING (rid)) WHERE k <> ''"""
    kinds, roles = [quoted(k) for k in secrets.KINDS], [quoted(secrets.ROLES[k]) for k in secrets.KINDS]
    enough = " OR ".join(
        f"kind = {secrets.KINDS.index(k)} AND " + " AND ".join(f"list_contains(near, {quoted(r)})" for r in needs) for k, needs in secrets.NEEDS.items()
    )
    say = f"[{', '.join(kinds)}][kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT)"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({matches("assign", secrets.ASSIGN, 2, 6)} UNION ALL {matches("access", secrets.ACCESS)} UNION ALL {matches("hex", secrets.HEX)}),
maybe AS ({matches("account", secrets.ACCOUNT)} UNION ALL {key} UNION ALL {matches("endpoint", secrets.ENDPOINT)}),
weak AS (SELECT * FROM maybe w WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = w.rid AND b.start < w.stop AND b.stop > w.start)),
every AS (SELECT *, [{', '.join(roles)}][kind + 1] AS role FROM (SELECT * FROM base UNION ALL SELECT * FROM weak)),
linked AS (
    SELECT rid, kind, start, stop FROM (
        SELECT w.*, list(DISTINCT o.role) AS near FROM weak w JOIN every o ON o.rid = w.rid AND o.start < w.stop + {secrets.SCOPE} AND o.stop > w.start - {secrets.SCOPE} GROUP BY ALL
    ) WHERE {enough}
),
based AS (
    SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
        string_agg({say}, ',' ORDER BY start, kind, stop) AS said FROM base GROUP BY rid
),
told AS (SELECT rid, string_agg({say}, ',' ORDER BY start, kind, stop) AS said FROM (SELECT * FROM base UNION ALL SELECT * FROM linked) GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(based.said, '')) AS base_sha256, coalesce(told.said, '') AS spans
FROM docs LEFT JOIN based USING (rid) LEFT JOIN told USING (rid)
"""


SQL["op9_secret_scan"] = _secrets()

SQL["op10_line_dedup"] = r"""
WITH lines AS (
    SELECT doc_id, i, line, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM (
        SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
    )
),
shared AS (
    SELECT k, min(doc_id) AS owner FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
),
marked AS (
    SELECT l.doc_id, i, line, s.owner IS NOT NULL AND s.owner < l.doc_id AS gone FROM lines l LEFT JOIN shared s USING (k)
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


#: ``<`` and ``|`` get one more backslash between them; a role has its backslashes and line ends spelt out first.
_ESCAPED = r"""regexp_replace({x}, '<(\\*)\|', '<\\\1|', 'g')"""
_ROLE = _ESCAPED.format(x=r"replace(replace(role, '\', '\\'), chr(10), '\n')")

SQL["op11_chat_formatting"] = rf"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
        SELECT conv_id, turn, role, text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
),
formatted AS (SELECT *, '<|im_start|>' || {_ROLE} || chr(10) || {_ESCAPED.format(x="text")} || '<|im_end|>' || chr(10) AS f FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(f)) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_attachments
FROM formatted GROUP BY conv_id
"""

_FILTERS = filteraudit.FILTERS
_PLACES = ", ".join(f"position('{f}' IN o) AS p{f}" for f in _FILTERS)
_GONE = "least(" + ", ".join(f"CASE WHEN {f} THEN p{f} ELSE 6 END" for f in _FILTERS) + ")"
_FAILS = " ".join(f"WHEN '{f}' THEN {f}" for f in _FILTERS)
_ALONE = "(" + " + ".join(f"CAST({f} AS INT)" for f in _FILTERS) + ") = 1"

SQL["op12_filter_audit"] = rf"""
WITH words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
said AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
flags AS (
    SELECT part, len(w) < {filteraudit.MIN_WORDS} AS A, 100 * len(list_distinct(w)) < {filteraudit.MIN_DISTINCT} * len(w) AS B,
        100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {filteraudit.MAX_UPPER} * length(t) AS C, regexp_matches(t, '[#$%&*|]') AS D,
        coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS E, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
    FROM words LEFT JOIN said USING (doc_id)
),
cells AS (SELECT part, A, B, C, D, E, count(*) AS n, sum(CAST(good AS INT)) AS good, sum(CAST(toxic AS INT)) AS toxic FROM flags GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
gone AS (SELECT *, {_GONE} AS gone FROM cells, (SELECT o, {_PLACES} FROM orders)),
steps AS (
    SELECT part, o, step, o[step] AS f, sum(n) FILTER (gone > step) AS kept, sum(n) FILTER (gone = step) AS removed,
        sum(n) FILTER (gone < step AND CASE o[step] {_FAILS} END) AS redundant,
        sum(n) FILTER (CASE o[step] {_FAILS} END AND {_ALONE}) AS unique_fails,
        sum(good) FILTER (gone = step) AS good_lost, sum(toxic) FILTER (gone = step) AS toxic_lost
    FROM gone, (SELECT unnest(range(1, 6)) AS step) GROUP BY part, o, step
)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step,
    {", ".join(f"CAST(coalesce({m}, 0) AS BIGINT) AS {m}" for m in filteraudit.MEASURES[:-1])},
    CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley
FROM steps
"""

SQL["op13_hard_negatives"] = f"""
WITH fine AS (
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor({hardneg.SCALE} * CAST(x AS DOUBLE))) AS q
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT a.id AS anchor_id, a.label = c.label AS same, c.id, CAST(list_dot_product(a.q, c.q) AS BIGINT) AS score
    FROM (SELECT * FROM fine WHERE id % 50 = 0) a JOIN fine c ON c.id <> a.id
),
positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {hardneg.POSITIVES}
),
negatives AS (
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS place, id, positive_score, score
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT same AND {hardneg.LOW} * positive_score <= 100 * score AND 100 * score <= {hardneg.HIGH} * positive_score
)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score FROM negatives WHERE place <= {hardneg.NEGATIVES}
"""
