"""DuckDB SQL that gives the rows of the registered queries."""

from __future__ import annotations

from maskwright.functions import bioes, language
from maskwright.plans import queries as q

_LUHN = "list_sum(list_transform(range(1, length({v}) + 1), lambda h: CASE WHEN (length({v}) - h) % 2 = 0 THEN substr({v}, h, 1)::INT ELSE (substr({v}, h, 1)::INT * 2) % 10 + (substr({v}, h, 1)::INT * 2) // 10 END)) % 10 = 0"


def _text(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _candidates(rules, source: str, keys: str, checks: dict[str, str]) -> str:
    """Rows (keys, prio, s, e, ord, label) of all rules' matches."""
    parts = []
    for ord, rule in enumerate(rules):
        p = _text(rule.pattern)
        keep = checks.get(rule.verify, "true").format(v="m[i]")
        parts.append(
            f"SELECT {keys}, {rule.priority} AS prio, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::INTEGER AS s, "
            f"length(m[i])::INTEGER AS n, {ord} AS ord, {_text(rule.label)} AS label FROM (SELECT {keys}, m, g, unnest(range(1, len(m) + 1)) AS i FROM "
            f"(SELECT {keys}, regexp_extract_all(text, {p}) AS m, string_split_regex(text, {p}) AS g FROM {source} WHERE regexp_matches(text, {p}))) WHERE {keep}"
        )
    return " UNION ALL ".join(parts)


def _spans(rules, source: str = "documents", keys: str = "doc_id", checks: dict[str, str] | None = None) -> str:
    """CTEs that end with sp (keys, label, start, end)."""
    return f"""
c AS ({_candidates(rules, source, keys, checks or {})}),
l AS (SELECT {keys}, list({{'s': s, 'e': s + n, 'label': label}} ORDER BY prio DESC, n DESC, s, ord) AS xs FROM c GROUP BY {keys}),
k AS (SELECT {keys}, unnest(list_reduce(list_transform(xs, lambda x: [x]), lambda acc, x:
  CASE WHEN len(list_filter(acc, lambda t: t.s < x[1].e AND x[1].s < t.e)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS z FROM l),
sp AS (SELECT {keys}, z.label AS label, z.s AS "start", z.e AS "end" FROM k)"""


def _masked(source: str, keys: str, placeholder: str, wanted: str = "true", more: str = "", found: str = "sp") -> str:
    """Redacted texts and span counts from the spans of ``found``."""
    on = " AND ".join(f"d.{k.strip()} = r.{k.strip()}" for k in keys.split(","))
    own = ", ".join(f"d.{k.strip()}" for k in keys.split(","))
    return f"""
b AS (SELECT *, lag("end") OVER (PARTITION BY {keys} ORDER BY "start", "end") AS last FROM {found} WHERE {wanted}),
r AS (SELECT {keys}, count(*)::INTEGER AS n, list({{'g': coalesce(last, 0), 's': "start", 'e': "end", 'p': {placeholder}}} ORDER BY "start", "end") AS xs FROM b GROUP BY {keys})
SELECT {own}{more}, CASE WHEN r.n IS NULL THEN text ELSE array_to_string(list_transform(xs, lambda x: substr(text, x.g + 1, x.s - x.g) || replace(x.p, '{{}}', substr(text, x.s + 1, x.e - x.s))), '') || substr(text, xs[-1].e + 1) END AS redacted_text,
  coalesce(r.n, 0)::INTEGER AS span_count FROM {source} d LEFT JOIN r ON {on}"""


_TYPED = "'<' || label || '>'"
_LINES = f"""
ln AS (SELECT l_orderkey, [{', '.join(map(_text, q.KINDS))}][l_partkey % 3 + 1] AS label, ((l_suppkey * 7 + l_linenumber * 3) % 40)::INTEGER AS "start",
  ((l_suppkey * 7 + l_linenumber * 3) % 40 + l_quantity::INTEGER % 7)::INTEGER AS "end", l_returnflag, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem)"""
_PLACE = "l_linenumber, l_partkey, l_suppkey, l_quantity"
_PRF = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 4) AS "precision", round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 4) AS recall,
  round(CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) ELSE 0 END, 4) AS f1, tp, fp, fn"""


def _matched(keys: str) -> str:
    return f"""{_LINES},
g AS (SELECT DISTINCT {keys} FROM ln WHERE l_returnflag <> 'R'), p AS (SELECT DISTINCT {keys} FROM ln WHERE l_returnflag <> 'A'),
x AS (SELECT {keys}, bool_or(g) AS g, bool_or(p) AS p FROM (SELECT {keys}, true AS g, false AS p FROM g UNION ALL SELECT {keys}, false, true FROM p) GROUP BY {keys})"""


_COUNTS = "count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE p AND NOT g) AS fp, count(*) FILTER (WHERE g AND NOT p) AS fn"
_ROUTED = ", ".join(f"({-i}, {_text(t)})" for i, t in q.ROUTED)
_EVERY = f"t AS (SELECT * FROM (VALUES {_ROUTED}) v(id, text) UNION ALL SELECT doc_id, text FROM documents)"


def _count(script: str) -> str:
    return f"len(regexp_extract_all(text, {_text(language.script_class(script))}))::INTEGER AS {script.lower()}"


def _form(characters: str) -> str:
    return f"(length(text) - length(translate(text, {_text(characters)}, '')))"


_SCRIPTS = ", ".join(_count(s) for s in language.SCRIPTS)
_ROUTE = f"""
WITH {_EVERY}, n AS (SELECT id, text, {_SCRIPTS}, {_form(language.SIMPLIFIED)} AS simp, {_form(language.TRADITIONAL)} AS trad FROM t),
m AS (SELECT id, list_sort([
    {{'r': -hangul, 'o': 0, 'c': 'ko'}}, {{'r': -(hiragana + katakana), 'o': 1, 'c': 'ja'}},
    {{'r': CASE WHEN hiragana + katakana > 0 THEN -han ELSE 0 END, 'o': 2, 'c': 'ja'}},
    {{'r': CASE WHEN hiragana + katakana > 0 THEN 0 ELSE -han END, 'o': 3, 'c': CASE WHEN trad > simp THEN 'zh-Hant' ELSE 'zh-Hans' END}}])[1] AS best, latin FROM n),
w AS (SELECT id, CASE WHEN best.r < 0 THEN best.c WHEN latin > 0 THEN 'en' END AS detected FROM m)
SELECT id, detected, coalesce(detected, 'en') AS routed FROM w"""

_TAGGED = f"""
tk AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_PLACE}) - 1 AS pos,
  [{', '.join(map(_text, q.TAGS))}][l_partkey % 9 + 1] AS tag, l_suppkey % 11 = 0 AS special FROM lineitem)"""

_DECODE = f"""
WITH {_TAGGED},
o AS (SELECT l_orderkey, pos, CASE WHEN special THEN 'O' ELSE tag END AS tag FROM tk),
a AS (SELECT *, lag(tag) OVER (PARTITION BY l_orderkey ORDER BY pos) AS last FROM o),
s AS (SELECT *, (tag[1] IN ('B', 'S') OR last IS NULL OR last = 'O' OR last[1] IN ('E', 'S') OR substr(last, 3) <> substr(tag, 3)) AS fresh FROM a),
i AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY l_orderkey ORDER BY pos) AS island FROM s WHERE tag <> 'O')
SELECT l_orderkey, substr(min(tag), 3) AS label, (min(pos) * 3)::INTEGER AS "start", (max(pos) * 3 + 2)::INTEGER AS "end" FROM i GROUP BY l_orderkey, island"""

_VALID = f"""
WITH {_TAGGED},
a AS (SELECT *, lead(tag) OVER (PARTITION BY l_orderkey ORDER BY pos) AS nxt FROM tk),
v AS (SELECT l_orderkey, CASE WHEN nxt IS NULL THEN tag[1] NOT IN ('B', 'I')
  WHEN tag[1] IN ('B', 'I') THEN nxt[1] IN ('I', 'E') AND substr(nxt, 3) = substr(tag, 3) ELSE nxt[1] IN ('O', 'B', 'S') END AS ok FROM a)
SELECT l_orderkey, bool_and(ok) AS valid FROM v GROUP BY l_orderkey"""


def _encoded(value: str, name: str) -> str:
    return f"""
WITH {_LINES},
sx AS (SELECT l_orderkey, label, "start", "end", row_number() OVER (PARTITION BY l_orderkey ORDER BY {_PLACE}) AS k FROM ln),
tk AS (SELECT i, i * 4 AS s, CASE WHEN i = 0 THEN 0 ELSE i * 4 + 3 END AS e FROM range(10) r(i)),
h AS (SELECT l_orderkey, k, label, i, row_number() OVER (PARTITION BY l_orderkey, k ORDER BY i) AS a, row_number() OVER (PARTITION BY l_orderkey, k ORDER BY i DESC) AS z
  FROM sx JOIN tk ON e > s AND s < "end" AND e > "start"),
w AS (SELECT l_orderkey, i, max_by(CASE WHEN a = 1 AND z = 1 THEN 'S' WHEN a = 1 THEN 'B' WHEN z = 1 THEN 'E' ELSE 'I' END || '-' || label, k) AS tag FROM h GROUP BY l_orderkey, i),
e AS (SELECT o.l_orderkey, tk.i, coalesce(w.tag, 'O') AS tag FROM (SELECT DISTINCT l_orderkey FROM lineitem) o CROSS JOIN tk LEFT JOIN w ON w.l_orderkey = o.l_orderkey AND w.i = tk.i)
SELECT l_orderkey, string_agg({value}, ',' ORDER BY i) AS {name} FROM e GROUP BY l_orderkey"""


_COALESCE = f"""
WITH {_LINES},
l AS (SELECT l_orderkey, list({{'label': label, 's': "start", 'e': "end"}} ORDER BY "start", "end", {_PLACE}) AS xs FROM ln GROUP BY l_orderkey),
k AS (SELECT l_orderkey, unnest(list_reduce(list_transform(xs, lambda x: [x]), lambda acc, x:
  CASE WHEN acc[-1].label = x[1].label AND x[1].s <= acc[-1].e
    THEN list_concat(acc[1:len(acc) - 1], [{{'label': x[1].label, 's': acc[-1].s, 'e': greatest(acc[-1].e, x[1].e)}}]) ELSE list_concat(acc, x) END)) AS z FROM l)
SELECT l_orderkey, z.label AS label, z.s AS "start", z.e AS "end" FROM k"""

_WORDS = """
wd AS (SELECT p_partkey, p_name, length(split_part(p_name, ' ', 1))::INTEGER AS w, length(p_name)::INTEGER AS n FROM part),
ws AS (SELECT p_partkey, p_name, 0 AS s, w AS e FROM wd UNION ALL SELECT p_partkey, p_name, w, n FROM wd)"""


def _trimmed() -> str:
    own, size, arms = "substr(p_name, s + 1, e - s)", "(e - s)", []
    for trim in q.TRIMS:
        longest = "CASE " + " ".join(f"WHEN ends_with({own}, {_text(trim.after + x)}) THEN {len(x)}" for x in sorted(trim.suffixes, key=len, reverse=True)) + " END"
        arms.append(f"WHEN label = {_text(trim.label)} AND {size} - ({longest}) >= {trim.min_keep} THEN ({longest})")
    return f"""
WITH {_WORDS}, lb AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 'PER' ELSE 'DATE' END AS label FROM ws)
SELECT p_partkey, label, s AS "start", (e - CASE {' '.join(arms)} ELSE 0 END)::INTEGER AS "end" FROM lb"""


_BEATEN = " OR ".join(f"(a.label IN ({', '.join(map(_text, r.over))}) AND b.label = {_text(r.label)})" for r in q.PRECEDENCE)
_NER = f"""
WITH {_LINES}
SELECT a.l_orderkey, a.label, a."start", a."end" FROM ln a WHERE a.l_returnflag = 'A' AND NOT EXISTS (
  SELECT 1 FROM ln b WHERE b.l_orderkey = a.l_orderkey AND b.l_returnflag <> 'A' AND a."end" > b."start" AND a."start" < b."end" AND ({_BEATEN}))"""


_SPAN = "STRUCT(label VARCHAR, s INTEGER, e INTEGER, i INTEGER)"
_MERGE = f"""
WITH {_LINES},
o AS (SELECT l_orderkey, {{'label': label, 's': "start", 'e': "end", 'i': (row_number() OVER (PARTITION BY l_orderkey, l_returnflag = 'A' ORDER BY {_PLACE}))::INTEGER}}::{_SPAN} AS x, l_returnflag = 'A' AS regex FROM ln),
l AS (SELECT l_orderkey, coalesce(list(x ORDER BY x.i) FILTER (WHERE regex), []) AS rx, coalesce(list(x ORDER BY x.i) FILTER (WHERE NOT regex), []) AS nx FROM o GROUP BY l_orderkey),
a AS (SELECT l_orderkey, nx, flatten(list_transform(nx, lambda t: nx)) AS rounds, list_transform(rx, lambda r: {{'used': []::INTEGER[], 'done': []::{_SPAN}[], 'r': r}}) AS steps FROM l),
g AS (SELECT l_orderkey, nx, list_reduce(list_prepend({{'used': []::INTEGER[], 'done': []::{_SPAN}[], 'r': NULL::{_SPAN}}}, steps), lambda acc, x:
  list_transform([list_reduce(list_prepend({{'s': x.r.s, 'e': x.r.e, 'used': acc.used, 'n': NULL::{_SPAN}}}, list_transform(rounds, lambda n: {{'s': 0, 'e': 0, 'used': []::INTEGER[], 'n': n}})), lambda st, y:
    CASE WHEN y.n.label = x.r.label AND st.s < y.n.e AND st.e > y.n.s AND NOT list_contains(st.used, y.n.i)
      THEN {{'s': least(st.s, y.n.s), 'e': greatest(st.e, y.n.e), 'used': list_append(st.used, y.n.i), 'n': NULL::{_SPAN}}} ELSE st END)],
    lambda z: {{'used': z.used, 'done': list_append(acc.done, {{'label': x.r.label, 's': z.s, 'e': z.e, 'i': x.r.i}}::{_SPAN}), 'r': NULL::{_SPAN}}})[1]) AS m FROM a),
c AS (
  SELECT l_orderkey, 0 AS origin, unnest(m.done) AS x FROM g
  UNION ALL SELECT l_orderkey, 1, unnest(list_filter(nx, lambda n: NOT list_contains(m.used, n.i))) FROM g),
k AS (SELECT l_orderkey, list(x ORDER BY origin, x.s - x.e, x.s, x.i) AS xs FROM c GROUP BY l_orderkey),
t AS (SELECT l_orderkey, unnest(list_reduce(list_transform(xs, lambda x: [x]), lambda acc, x:
  CASE WHEN len(list_filter(acc, lambda p: p.s < x[1].e AND x[1].s < p.e)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS z FROM k)
SELECT l_orderkey, z.label AS label, z.s AS "start", z.e AS "end" FROM t"""


def _viterbi() -> str:
    names = q.VITERBI_LABELS
    matrix = bioes.transition_matrix(names, bioes.resolve_operating_point("high_recall")).tolist()
    table = "[" + ", ".join("[" + ", ".join(f"({x!r})::DOUBLE" for x in row) + "]" for row in matrix) + "]"
    labels = "[" + ", ".join(map(_text, names)) + "]"
    scores = ", ".join(f"((l_partkey * {j + 1} + l_suppkey) % 7)::DOUBLE" for j in range(len(names)))
    k = f"range(1, {len(names) + 1})"
    return f"""
WITH RECURSIVE em AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_PLACE}) AS t, [{scores}] AS x FROM lineitem),
st AS (
  SELECT l_orderkey, t, x AS sc, {labels} AS pa FROM em WHERE t = 1
  UNION ALL
  SELECT l_orderkey, t, list_transform({k}, lambda j: list_max(bs[j]) + x[j]), list_transform({k}, lambda j: pa[list_position(bs[j], list_max(bs[j]))] || ',' || ({labels})[j])
  FROM (SELECT st.l_orderkey, em.t, em.x, st.pa, list_transform({k}, lambda j: list_transform({k}, lambda i: st.sc[i] + ({table})[i][j])) AS bs
    FROM st JOIN em ON em.l_orderkey = st.l_orderkey AND em.t = st.t + 1))
SELECT l_orderkey, max_by(pa[list_position(sc, list_max(sc))], t) AS path FROM st GROUP BY l_orderkey"""


def _matrix() -> str:
    names = bioes.label_list()
    point = dict(zip(bioes.CATEGORIES, bioes.resolve_operating_point("high_recall"), strict=True))
    scores = " ".join(f"WHEN {_text(c)} THEN ({v!r})::DOUBLE" for c, v in point.items())
    values = ", ".join(f"({_text(x)})" for x in names)
    return f"""
WITH n AS (SELECT * FROM (VALUES {values}) v(x)),
c AS (SELECT a.x AS previous, b.x AS following, CASE
  WHEN a.x[1] IN ('B', 'I') THEN CASE WHEN substr(a.x, 3) = substr(b.x, 3) AND b.x[1] = 'I' THEN 'inside' WHEN substr(a.x, 3) = substr(b.x, 3) AND b.x[1] = 'E' THEN 'end' END
  WHEN b.x = 'O' THEN CASE WHEN a.x = 'O' THEN 'outside' ELSE 'exit' END WHEN b.x[1] = 'B' THEN 'begin' WHEN b.x[1] = 'S' THEN 'single' END AS category FROM n a, n b)
SELECT *, coalesce(CASE category {scores} END, ({bioes.ILLEGAL!r})::DOUBLE) AS score FROM c"""


def _biases() -> str:
    base = (0.25, -0.5, 0.0, 1.0, 2.0, -1.5)
    rows = [f"({_text(name)}, {k}, {b!r}::DOUBLE + ({p!r})::DOUBLE)" for name, point in bioes.OPERATING_POINTS.items() for k, (b, p) in enumerate(zip(base, point, strict=True))]
    return f"SELECT name, place::INTEGER AS place, bias FROM (VALUES {', '.join(rows)}) v(name, place, bias)"


def _summary() -> str:
    return f"""
WITH {_spans(q.RULES)},
n AS (SELECT doc_id, label, count(*) AS n FROM sp GROUP BY doc_id, label)
SELECT label, sum(n)::BIGINT AS n_spans, count(*) AS n_rows FROM n GROUP BY label"""


_RESULT = f"""
WITH {_spans(q.RULES)},
x AS (SELECT sp.*, substr(d.text, "start" + 1, "end" - "start") AS own FROM sp JOIN documents d ON d.doc_id = sp.doc_id),
n AS (SELECT doc_id, label, count(*) AS n FROM x GROUP BY doc_id, label),
m AS (SELECT doc_id, sum(n)::INTEGER AS spans, string_agg('"' || label || '":' || n, ',' ORDER BY label) AS labels FROM n GROUP BY doc_id),
j AS (SELECT doc_id, string_agg('{{"label":"' || label || '","start":' || "start" || ',"end":' || "end" || ',"text":"' || own || '","placeholder":"<' || label || '>"}}', ',' ORDER BY "start") AS found FROM x GROUP BY doc_id)
SELECT d.doc_id, '{{"output_mode":"typed","span_count":' || coalesce(m.spans, 0) || ',"by_label":{{' || coalesce(m.labels, '') || '}},"decoded_mismatch":false}}' AS summary,
  '[' || coalesce(j.found, '') || ']' AS detected_spans, 1 AS schema_version
FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id LEFT JOIN j ON j.doc_id = d.doc_id"""

_DOCS = f"WITH {_spans(q.RULES)}"

# the model's spans: the first word, with its suffix cut, and the six characters after it
_HYBRID = f"""
{_DOCS},
w AS (SELECT doc_id, text, length(regexp_extract(text, '^[^ ]*'))::INTEGER AS w FROM documents),
m AS (
  SELECT doc_id, text, 'PER' AS label, 0 AS s, (w - CASE WHEN ends_with(substr(text, 1, w), 'es') THEN CASE WHEN w >= 4 THEN 2 ELSE 0 END
    WHEN ends_with(substr(text, 1, w), 's') AND w >= 3 THEN 1 ELSE 0 END)::INTEGER AS e, w AS whole FROM w
  UNION ALL SELECT doc_id, text, 'LOC', w, w + 6, w + 6 FROM w),
n AS (SELECT doc_id, label, s, e FROM m WHERE trim(substr(text, s + 1, whole - s), E' \\t\\n\\r') NOT IN ('The', 'An')),
every AS (
  SELECT doc_id, label, "start", "end" FROM sp
  UNION ALL SELECT doc_id, label, s, e FROM n WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.doc_id = n.doc_id AND sp."start" < n.e AND sp."end" > n.s)),
{_masked('documents', 'doc_id', _TYPED, found='every')}"""

_PIECES = ", ".join(f"({-i}, {len(o)}, {sum(s for s, _ in o)}, {sum(e for _, e in o)}, {max(e for _, e in o)})" for i, _, _, o in q.PIECES)
_OFFSETS = f"""
WITH w AS (SELECT doc_id, string_split(text, ' ') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS k FROM w),
o AS (SELECT doc_id, x, k + sum(length(x)) OVER (PARTITION BY doc_id ORDER BY k) - 1 AS e FROM t),
f AS (SELECT doc_id, count(*) AS n, sum(e - length(x)) AS s, sum(e) AS e, max(e) AS last FROM o WHERE x <> '' GROUP BY doc_id)
SELECT d.doc_id AS id, coalesce(n, 0)::INTEGER AS n, coalesce(s, 0)::BIGINT AS starts, coalesce(e, 0)::BIGINT AS ends, coalesce(last, 0)::INTEGER AS last FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id
UNION ALL SELECT id, n::INTEGER, s::BIGINT, e::BIGINT, last::INTEGER FROM (VALUES {_PIECES}) v(id, n, s, e, last)"""

_DECODED = f"""
SELECT doc_id AS id, doc_id % 3 = 2 AS mismatch FROM documents
UNION ALL SELECT id, mismatch FROM (VALUES {', '.join(f"({-i}, {str(lost).lower()})" for i, _, _, lost in q.DECODED)}) v(id, mismatch)"""

# a record's number is the document's; gold has two of the rules
_EVAL_RUN = f"""
{_DOCS},
g AS (WITH {_spans((q.RULES[1], q.RULES[3]))} SELECT * FROM sp),
x AS (SELECT doc_id, label, "start", "end", bool_or(gold) AS g, bool_or(NOT gold) AS p FROM (SELECT *, true AS gold FROM g UNION ALL SELECT *, false FROM sp) GROUP BY doc_id, label, "start", "end"),
t AS (SELECT coalesce(label, 'micro') AS label, {_COUNTS} FROM x GROUP BY ROLLUP (label)) SELECT label, {_PRF} FROM t"""
_SP = 'SELECT doc_id, label, "start", "end" FROM sp'
ORACLE_SQL = {
    "regex_spans": f"{_DOCS} {_SP}",
    "greedy_priority": f"WITH {_spans(q.CROSSING)} {_SP}",
    "arrow_spans": f"WITH {_spans(q.CROSSING)} {_SP}",
    "luhn_gate": f"WITH {_spans(q.CHECKED, checks={'luhn': _LUHN})} {_SP}",
    "verify_fail_open": f"WITH {_spans(q.RULES[2:3])} {_SP}",
    "rrn_gate": """
WITH v AS (SELECT c_custkey, lpad((c_custkey * 104729 % 1000000)::VARCHAR, 6, '0') || '-' || lpad((c_custkey * 1299709 % 10000000)::VARCHAR, 7, '0') AS value FROM customer),
d AS (SELECT *, replace(value, '-', '') AS d FROM v)
SELECT c_custkey, value, (11 - list_sum(list_transform(range(1, 13), lambda i: substr(d, i, 1)::INT * ([2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5])[i])) % 11) % 10 = substr(d, 13, 1)::INT AS valid FROM d""",
    "redact_typed": f"{_DOCS}, {_masked('documents', 'doc_id', _TYPED)}",
    "redact_generic": f"{_DOCS}, {_masked('documents', 'doc_id', _text('<REDACTED>'))}",
    "redact_entity_filter": f"{_DOCS}, {_masked('documents', 'doc_id', _TYPED, "label IN ('EMAIL', 'PHONE')")}",
    "redact_conversations": f"WITH {_spans(q.RULES, 'conversations', 'conv_id, turn')}, {_masked('conversations', 'conv_id, turn', _TYPED, more=', d.role')}",
    "result_json": _RESULT,
    "highlight_plain": f"SELECT doc_id, redacted_text AS highlighted FROM ({_DOCS}, {_masked('documents', 'doc_id', "'[{}](' || label || ')'")})",
    "label_summary": _summary(),
    "script_counts": f"WITH {_EVERY} SELECT id, {_SCRIPTS} FROM t",
    "simp_trad": f"WITH {_EVERY} SELECT id, {_form(language.SIMPLIFIED)}::INTEGER AS simplified, {_form(language.TRADITIONAL)}::INTEGER AS traditional FROM t",
    "hybrid_redact": _HYBRID,
    "nfkc_offsets": _OFFSETS,
    "decode_mismatch": _DECODED,
    "eval_run": _EVAL_RUN,
    "route_language": _ROUTE,
    "auto_redact": f"SELECT doc_id, 'en' AS language, redacted_text, span_count FROM ({_DOCS}, {_masked('documents', 'doc_id', _TYPED)})",
    "label_space": "SELECT id::INTEGER AS id, label FROM (VALUES " + ", ".join(f"({i}, {_text(x)})" for i, x in enumerate(bioes.label_list())) + ") v(id, label)",
    "transition_matrix": _matrix(),
    "effective_biases": _biases(),
    "viterbi_path": _viterbi(),
    "viterbi_path_native": _viterbi(),
    "bioes_encode": _encoded("tag", "tags"),
    "bioes_decode": _DECODE,
    "valid_bioes": _VALID,
    "coalesce_spans": _COALESCE,
    "stopword_filter": f"""WITH {_WORDS} SELECT p_partkey, 'PER' AS label, s AS "start", e AS "end" FROM ws WHERE trim(substr(p_name, s + 1, e - s)) NOT IN ({', '.join(map(_text, q.STOPWORDS))})""",
    "span_trim": _trimmed(),
    "ner_precedence": _NER,
    "merge_union": _MERGE,
    "label_remap": f"""WITH {_LINES} SELECT l_orderkey, CASE label WHEN 'PER' THEN 'PERSON' ELSE 'PLACE' END AS label, "start", "end" FROM ln WHERE label IN ('PER', 'LOC')""",
    "eval_typed": f"""WITH {_matched('l_orderkey, label, "start", "end"')},
t AS (SELECT coalesce(label, 'micro') AS label, {_COUNTS} FROM x GROUP BY ROLLUP (label)) SELECT label, {_PRF} FROM t""",
    "eval_untyped": f"""WITH {_matched('l_orderkey, "start", "end"')}, t AS (SELECT {_COUNTS} FROM x) SELECT {_PRF} FROM t""",
    "eval_source_recall": f"""WITH {_LINES},
p AS (SELECT DISTINCT l_orderkey, "start", "end" FROM ln WHERE l_returnflag <> 'A')
SELECT g.label, round(avg(CASE WHEN p.l_orderkey IS NULL THEN 0.0::DOUBLE ELSE 1 END), 4) AS recall FROM ln g
LEFT JOIN p ON p.l_orderkey = g.l_orderkey AND p."start" = g."start" AND p."end" = g."end" WHERE g.l_returnflag <> 'R' GROUP BY g.label""",
    "train_label_ids": _encoded(f"CASE WHEN i = 0 THEN -100 ELSE list_position([{', '.join(map(_text, bioes.label_list(q.KINDS)))}], tag) - 1 END", "label_ids"),
    "pad_batches": """
WITH o AS (SELECT l_orderkey, floor(l_orderkey / 8) AS batch, list(l_linenumber ORDER BY l_linenumber) AS ids FROM lineitem GROUP BY l_orderkey),
m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS n FROM o)
SELECT l_orderkey, array_to_string(list_concat(ids, list_transform(range(len(ids), n), lambda x: 0)), ',') AS ids,
  array_to_string(list_transform(range(n), lambda x: CASE WHEN x < len(ids) THEN 1 ELSE 0 END), ',') AS attention_mask FROM m""",
    "focal_loss": """
WITH r AS (SELECT [l_discount * 10, l_tax * 10, l_quantity / 10] AS x, l_linenumber % 4 AS y FROM lineitem WHERE l_linenumber % 4 <> 3),
p AS (SELECT exp(x[y + 1] - list_max(x)) / list_sum(list_transform(x, lambda v: exp(v - list_max(x)))) AS p FROM r)
SELECT round(avg(-pow(1 - p, 2) * ln(p)), 4) AS focal_loss FROM p""",
    "stream_redact": f"{_DOCS}, {_masked('documents', 'doc_id', _TYPED)}",
    "latest_spans": f"""{_DOCS}, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start" DESC)::INTEGER AS place FROM sp) SELECT doc_id, label, "start", "end", place FROM f WHERE place <= 3""",
}
