"""DuckDB oracle SQL for every registered query (tables are pre-registered views).

Built independently of the Spark plans: the same lexicon and template constants, but
row-level SQL (window ranks, UNION ALL of evidence kinds) instead of the distributed
forms used on Spark. Dialect notes: DuckDB decimal literals are cast to DOUBLE where
Spark computes in double; ``regexp_matches`` (RE2) already treats ``.`` as "any
character but newline", so patterns go in as they stand.
"""

from __future__ import annotations

from prioscope.functions.text import PY_WHITESPACE, is_literal
from prioscope.lexicon import BASELINE, CORE, FULL, APP, LEVELS, Lexicon, preset
from prioscope.functions.scoring import STRICT_PRIORITY, WIDE_PRIORITY
from prioscope.operators import dossier as D
from prioscope.operators.dataset import MODEL_INPUT_FORMAT, SPLIT_CUTS, SPLIT_SEED
from prioscope.operators.metrics import THRESHOLDS
from prioscope.sources.driver_tables import (CHANNELS, PHRASE_BANK, PRIORITY_ALT_TEXT,
                                             PRIORITY_TEXT, TICKET_TYPES)

WS = " || ".join(f"chr({ord(ch)})" for ch in PY_WHITESPACE)


def lit(s: str | None) -> str:
    if s is None:
        return "NULL"
    parts = s.split("\n")
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts)


def lst(items) -> str:
    return "([" + ", ".join(lit(x) for x in items) + "]::VARCHAR[])"


def case_map(expr: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"(CASE {expr} {whens} END)"


def score_of(expr: str) -> str:
    return f"(CASE {expr} WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 WHEN 'Critical' THEN 4 ELSE 2 END)"


# ------------------------------------------------------------------ ticket adapter
def tickets_ctes() -> str:
    bank = ", ".join(f"({k}, {lit(s)}, {lit(d)})" for k, (s, d) in enumerate(PHRASE_BANK))
    norm = f"coalesce({case_map(f'lower(trim(priority, {WS}))', WIDE_PRIORITY)}, 'Medium')"
    return f"""
bank(k, subject, description) AS (VALUES {bank}),
raw AS (
  SELECT CAST(o.o_orderkey AS VARCHAR) AS ticket_id, o.o_orderkey AS order_key,
         b.subject, b.description,
         {case_map('o.o_orderpriority', PRIORITY_TEXT)} AS priority,
         coalesce({case_map('o.o_orderpriority', PRIORITY_ALT_TEXT)}, 'Unknown') AS priority_alt,
         floor(e.value * CAST(10.0 AS DOUBLE)) / CAST(10.0 AS DOUBLE) AS resolution_hours,
         {lst(CHANNELS)}[(o.o_orderkey % 4) + 1] AS channel,
         {lst(TICKET_TYPES)}[(o.o_custkey % 4) + 1] AS ticket_type,
         CAST(e.ts AS TIMESTAMP) AS ts,
         e.event_id IS NOT NULL AS has_event
  FROM orders o LEFT JOIN events e ON e.event_id = o.o_orderkey
  JOIN bank b ON b.k = (o.o_orderkey * 7 + o.o_custkey) % 16
),
tk AS (
  SELECT ticket_id, order_key, coalesce(subject, '') AS subject, coalesce(description, '') AS description,
         trim(coalesce(subject, '') || ' ' || coalesce(description, ''), {WS}) AS full_text,
         priority AS priority_raw, {norm} AS priority_norm, {score_of(norm)} AS priority_score,
         channel, ticket_type, CAST(resolution_hours AS DOUBLE) AS resolution_hours,
         priority_alt, ts, has_event
  FROM raw
),
bl AS (SELECT count(*) AS n, median(resolution_hours) AS hours_median FROM tk),
imp AS (SELECT t.* REPLACE (coalesce(t.resolution_hours, bl.hours_median) AS resolution_hours) FROM tk t, bl),
st AS (SELECT avg(resolution_hours) AS hours_mean, stddev_pop(resolution_hours) AS hours_std FROM imp)"""


def _hit(tl: str, item: str) -> str:
    if is_literal(item):
        return f"contains({tl}, {lit(item)})"
    return f"regexp_matches({tl}, {lit(item)})"  # RE2's dot stops at a newline by itself


def _count(tl: str, items) -> str:
    items = list(items)
    if not items:
        return "0"
    return "(" + " + ".join(f"CAST({_hit(tl, it)} AS INTEGER)" for it in items) + ")"


def _hits_in_order(tl: str, words) -> str:
    return f"list_filter({lst(words)}, lambda k: contains({tl}, k))"


def signal_ctes(lexicon, src: str, text_col: str, p: str) -> str:
    """CTE ``{p}sg`` = src + text-signal columns (top_kw stays a list)."""
    lx = preset(lexicon)
    w = lx.weights
    tl = "__tl"
    if lx.top_keywords == "crit_high":
        top = f"list_concat({_hits_in_order(tl, lx.crit)}[1:3], {_hits_in_order(tl, lx.high)}[1:2])[1:3]"
    else:
        top = f"{_hits_in_order(tl, lx.crit)}[1:3]"
    f = lambda x: f"CAST({x} AS DOUBLE)"
    return f"""
{p}s0 AS (SELECT *, lower(coalesce({text_col}, '')) AS {tl} FROM {src}),
{p}s1 AS (
  SELECT * EXCLUDE ({tl}),
         {_count(tl, lx.crit)} AS crit_kw_count, {_count(tl, lx.high)} AS high_kw_count,
         {_count(tl, lx.med)} AS med_kw_count, {_count(tl, lx.low)} AS low_kw_count,
         {_count(tl, lx.esc)} AS esc_phrase_count, {_count(tl, lx.neg)} AS negation_count,
         {top} AS top_kw
  FROM {p}s0),
{p}s2 AS (
  SELECT *, crit_kw_count * {f(w['crit'])} + esc_phrase_count * {f(w['esc'])}
            + negation_count * {f(w['neg'])} + high_kw_count * {f(w['high'])}
            + med_kw_count * {f(w['med'])} + low_kw_count * {f(w['low'])} AS nlp_score
  FROM {p}s1),
{p}sg AS (
  SELECT *, CASE WHEN nlp_score >= 6 OR esc_phrase_count >= 1 THEN 4
                 WHEN nlp_score >= 3 OR crit_kw_count >= 1 THEN 3
                 WHEN nlp_score >= 1 THEN 2 ELSE 1 END AS nlp_severity
  FROM {p}s2)"""


def audit_ctes(lexicon=CORE, mode: str = "fused", p: str = "") -> str:
    """CTE ``{p}au``: audited tickets (needs ``tickets_ctes`` first)."""
    inferred = ("CAST(least(greatest(round(fused_score), 1), 4) AS INTEGER)" if mode == "fused"
                else "CAST(nlp_severity AS INTEGER)")
    return signal_ctes(lexicon, "imp", "full_text", p) + f""",
{p}tz AS (
  SELECT s.*, (s.resolution_hours - st.hours_mean) / nullif(st.hours_std, 0) AS rt_zscore FROM {p}sg s, st),
{p}tf AS (
  SELECT *, CASE WHEN rt_zscore >= 1.5 THEN 4 WHEN rt_zscore >= 0.5 THEN 3
                 WHEN rt_zscore >= -0.5 THEN 2 ELSE 1 END AS rt_severity
  FROM {p}tz),
{p}fu AS (
  SELECT *, CAST(0.6 AS DOUBLE) * nlp_severity + CAST(0.4 AS DOUBLE) * rt_severity AS fused_score FROM {p}tf),
{p}inf AS (SELECT *, {inferred} AS inferred_severity FROM {p}fu),
{p}au AS (
  SELECT *, {lst(LEVELS)}[inferred_severity] AS inferred_severity_label,
         CAST(inferred_severity - priority_score AS INTEGER) AS severity_delta,
         CAST(abs(inferred_severity - priority_score) >= 2 AS INTEGER) AS mismatch_label,
         CASE WHEN abs(inferred_severity - priority_score) < 2 THEN 'Consistent'
              WHEN inferred_severity - priority_score > 0 THEN 'Hidden Crisis'
              ELSE 'False Alarm' END AS mismatch_type,
         array_to_string(top_kw, '|') AS top_keywords
  FROM {p}inf)"""


def with_audit(body: str, lexicon=CORE, mode="fused") -> str:
    return f"WITH {tickets_ctes()},{audit_ctes(lexicon, mode)}\n{body}"


def with_tickets(body: str) -> str:
    return f"WITH {tickets_ctes()}\n{body}"


def r6(x: str) -> str:
    return f"round({x}, 6)"


# ------------------------------------------------------------------ dossier pieces
def flagged_evidence_ctes() -> str:
    high = lst(D.HIGH_WEIGHT_KEYWORDS)
    esc_txt = lit(D.ESCALATION_TEXT)
    neg_txt = lit(D.NEGATION_TEXT)
    t = D.TIME_TEXT_NOTEBOOK
    c = D.CHANNEL_TEXT
    return f""",
fl AS (SELECT * FROM au WHERE mismatch_label = 1),
kwl AS (SELECT *, list_filter(top_kw, lambda k: contains(lower(full_text), lower(k))) AS kws,
               CAST(len(list_filter(top_kw, lambda k: contains(lower(full_text), lower(k)))) AS INTEGER) AS nk
        FROM fl),
kwr AS (SELECT ticket_id, CAST(generate_subscripts(kws, 1) - 1 AS INTEGER) AS pos, unnest(kws) AS value FROM kwl),
ev AS (
  SELECT ticket_id, pos, 'keyword' AS signal, value,
         CASE WHEN list_contains({high}, value) THEN 'high' ELSE 'medium' END AS weight,
         CAST(NULL AS VARCHAR) AS interpretation FROM kwr
  UNION ALL
  SELECT ticket_id, nk, 'escalation_phrase', printf({esc_txt}, esc_phrase_count), 'high', NULL
  FROM kwl WHERE esc_phrase_count > 0
  UNION ALL
  SELECT ticket_id, nk + CAST(esc_phrase_count > 0 AS INTEGER), 'negation',
         printf({neg_txt}, negation_count), 'medium', NULL
  FROM kwl WHERE negation_count > 0
  UNION ALL
  SELECT ticket_id, nk + CAST(esc_phrase_count > 0 AS INTEGER) + CAST(negation_count > 0 AS INTEGER),
         'resolution_time', printf('%.1f hours', resolution_hours), NULL,
         CASE WHEN resolution_hours > 72 THEN {lit(t[0])} WHEN resolution_hours > 24 THEN {lit(t[1])}
              ELSE {lit(t[2])} END
  FROM kwl
  UNION ALL
  SELECT ticket_id, nk + CAST(esc_phrase_count > 0 AS INTEGER) + CAST(negation_count > 0 AS INTEGER) + 1,
         'channel', channel, NULL,
         CASE WHEN lower(channel) IN ('phone', 'social media') THEN {lit(c[0])} ELSE {lit(c[1])} END
  FROM kwl
)"""


def _evidence_sql(src: str, value: str, texts, shown: str) -> str:
    """Evidence of the CLI and app styles: keywords of the text, then the resolution time."""
    flagged = "fl AS (SELECT * FROM au WHERE mismatch_label = 1),\n" if src == "fl" else ""
    return f""",
{flagged}kwl AS (SELECT *, list_filter(top_kw, lambda k: contains(lower(full_text), lower(k))) AS kws FROM {src})
SELECT ticket_id, CAST(generate_subscripts(kws, 1) - 1 AS INTEGER) AS pos, 'keyword' AS signal, unnest(kws) AS value, 'high' AS weight,
       CAST(NULL AS VARCHAR) AS interpretation FROM kwl
UNION ALL
SELECT ticket_id, CAST(len(kws) AS INTEGER), 'resolution_time', {value}, NULL,
       CASE WHEN resolution_hours > 48 THEN {lit(texts[0])} ELSE {lit(texts[1])} END FROM kwl WHERE {shown}"""


def notebook_analysis() -> str:
    return (f"CASE WHEN severity_delta > 0 THEN printf({lit(D.ANALYSIS_NOTEBOOK_CRISIS)}, crit_kw_count, "
            f"esc_phrase_count, inferred_severity_label, priority_norm, abs(severity_delta), resolution_hours) "
            f"ELSE printf({lit(D.ANALYSIS_NOTEBOOK_ALARM)}, priority_norm, inferred_severity_label, "
            f"crit_kw_count, resolution_hours, abs(severity_delta)) END")


def prompt_sql() -> str:
    tpl = D.PROMPT_TEMPLATE.replace("%", "%%").format(
        ticket_id="%s", subject="%s", description="%s", channel="%s", hours="%s",
        assigned="%s", inferred="%s", delta="%d", crit="%d", esc="%d", top_keywords="%s",
        schema=D.PROMPT_SCHEMA.replace("%", "%%"))
    return (f"printf({lit(tpl)}, ticket_id, coalesce(subject, ''), "
            f"coalesce(full_text, ''), coalesce(channel, ''), "
            f"coalesce(CAST(resolution_hours AS VARCHAR), ''), coalesce(priority_norm, ''), "
            f"coalesce(inferred_severity_label, ''), severity_delta, crit_kw_count, esc_phrase_count, "
            f"top_keywords)")


# ------------------------------------------------------------------ queries
def _text_signal_sql(lexicon) -> str:
    return with_tickets("," + signal_ctes(lexicon, "tk", "full_text", "") + """
SELECT ticket_id, crit_kw_count, high_kw_count, med_kw_count, low_kw_count, esc_phrase_count,
       negation_count, nlp_score, nlp_severity, array_to_string(top_kw, '|') AS top_keywords FROM sg""")


def _document_sql() -> str:
    from prioscope.plans.queries import DOCUMENT_LEXICON
    return "WITH docs AS (SELECT doc_id, text FROM documents)," + signal_ctes(DOCUMENT_LEXICON, "docs", "text", "") + """
SELECT doc_id, crit_kw_count, high_kw_count, esc_phrase_count, negation_count, nlp_score,
       nlp_severity, array_to_string(top_kw, '|') AS top_keywords FROM sg"""


# a number as a whole field, written apart from the pattern under test
NUMBER = r"[-+]?([0-9]+([.][0-9]*)?|[.][0-9]+)([Ee][-+]?[0-9]+)?"


def _hours_coerced_sql() -> str:
    v = "value"
    txt = (f"CASE event_id % 8 WHEN 0 THEN printf('%.2f', {v}) "
           f"WHEN 1 THEN '  ' || printf('%.2f', {v}) || chr(9) "
           f"WHEN 2 THEN printf('%.2fh', {v}) "
           f"WHEN 3 THEN CAST(CAST(floor({v}) AS BIGINT) AS VARCHAR) || 'e0' "
           f"WHEN 4 THEN 'inf' WHEN 5 THEN '' WHEN 6 THEN '1e999' "
           f"ELSE '+' || printf('%.2f', {v}) END")
    return f"""
WITH ht AS (SELECT CAST(event_id AS VARCHAR) AS ticket_id, trim({txt}, {WS}) AS h FROM events),
pc AS (SELECT ticket_id, CASE WHEN regexp_full_match(h, {lit(NUMBER)}) THEN TRY_CAST(h AS DOUBLE) END AS v FROM ht),
pf AS (SELECT ticket_id, CASE WHEN isfinite(v) THEN v END AS v FROM pc),
md AS (SELECT median(v) AS m FROM pf)
SELECT ticket_id, coalesce(v, m) AS resolution_hours, CAST(v IS NULL AS INTEGER) AS hours_imputed FROM pf, md"""


def _null_counts_sql() -> str:
    cols = ["ticket_id", "order_key", "subject", "description", "priority", "priority_alt",
            "resolution_hours", "channel", "ticket_type", "ts"]
    parts = " UNION ALL ".join(
        f"SELECT {lit(c)} AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS null_count FROM raw"
        for c in cols)
    return with_tickets(parts)


def _split_sql(src: str = "au") -> str:
    c1, c2 = SPLIT_CUTS
    return f"""sp AS (
  SELECT ticket_id, mismatch_label,
         CASE WHEN r <= floor(n * CAST({c1} AS DOUBLE)) THEN 'train'
              WHEN r <= floor(n * CAST({c2} AS DOUBLE)) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT ticket_id, mismatch_label,
               row_number() OVER (PARTITION BY mismatch_label
                                  ORDER BY md5(ticket_id || '|' || '{SPLIT_SEED}'), ticket_id) AS r,
               count(*) OVER (PARTITION BY mismatch_label) AS n
        FROM {src}))"""


def _metric_ctes(labelled: str = "SELECT mismatch_label AS label, CAST(abs(nlp_severity - priority_score) >= 2 AS INTEGER) AS prediction FROM au") -> str:
    return f""",
lp AS ({labelled}),""" + """
cn AS (SELECT count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
              count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
              count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
              count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn FROM lp),
pc AS (SELECT *,
        coalesce(CAST(tn AS DOUBLE) / nullif(tn + fn, 0), 0) AS precision0,
        coalesce(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 0) AS recall0,
        coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision1,
        coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall1,
        tn + fp AS support0, tp + fn AS support1 FROM cn),
pf AS (SELECT *,
        CASE WHEN precision0 + recall0 > 0 THEN 2 * precision0 * recall0 / (precision0 + recall0) ELSE 0 END AS f1_0,
        CASE WHEN precision1 + recall1 > 0 THEN 2 * precision1 * recall1 / (precision1 + recall1) ELSE 0 END AS f1_1
       FROM pc),
mr AS (SELECT coalesce(CAST(tp + tn AS DOUBLE) / nullif(tp + fp + fn + tn, 0), 0) AS accuracy,
              (f1_0 + f1_1) / 2 AS macro_f1, recall0 AS recall_class0, recall1 AS recall_class1 FROM pf),
mt AS (SELECT round(accuracy, 4) AS accuracy, round(macro_f1, 4) AS macro_f1,
              round(recall_class0, 4) AS recall_class0, round(recall_class1, 4) AS recall_class1 FROM mr)"""


def _arrival_ctes() -> str:
    """``wm``: each slice's watermark (newest time of the earlier slices less one hour, in
    milliseconds); ``arrived``: every arriving row with how it came."""
    return """
ev AS (SELECT *, (date_diff('day', CAST((SELECT min(ts) FROM events) AS DATE), CAST(ts AS DATE)) // 10)
                 + CAST(event_id % 37 = 5 AS INTEGER) AS own, epoch_ms(ts) AS ms FROM events),
arr AS (SELECT event_id, ts, ms, own AS slice, 0 AS copy FROM ev UNION ALL
        SELECT event_id, ts, ms, own, 1 FROM ev WHERE event_id % 11 = 3 UNION ALL
        SELECT event_id, ts, ms, own + 1, 2 FROM ev WHERE event_id % 23 = 7),
wm AS (SELECT s.slice, coalesce(max(a.ms) - 3600000, 0) AS edge FROM (SELECT DISTINCT slice FROM arr) s
       LEFT JOIN arr a ON a.slice < s.slice GROUP BY s.slice),
tm AS (SELECT a.*, edge, row_number() OVER (PARTITION BY event_id, a.slice ORDER BY copy) AS nth,
              min(CASE WHEN ms > edge THEN a.slice END) OVER (PARTITION BY event_id) AS came
       FROM arr a JOIN wm USING (slice)),
arrived AS (SELECT *, CASE WHEN came < slice AND ms + 3600000 > edge THEN 'repeat' WHEN ms <= edge THEN 'late'
                      WHEN nth > 1 THEN 'repeat' ELSE 'on_time' END AS arrival FROM tm)"""


def _stream_arrivals_sql() -> str:
    return f"""WITH {_arrival_ctes()}
SELECT CAST(event_id AS VARCHAR) AS ticket_id, arrival, count(*) AS copies FROM arrived
WHERE event_id IN (SELECT o_orderkey FROM orders) GROUP BY ALL"""


def _stream_daily_sql() -> str:
    return with_audit("," + _arrival_ctes() + """,
came AS (SELECT CAST(event_id AS VARCHAR) AS ticket_id, max(CAST(arrival = 'on_time' AS INTEGER)) AS on_time FROM arrived GROUP BY 1)
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, mismatch_type, count(*) AS n,
       CAST(sum(1 - on_time) AS BIGINT) AS n_late
FROM au JOIN came USING (ticket_id) GROUP BY ALL""")


def _newton_sql(tail: str) -> str:
    """The classifier again: Newton steps by Gauss-Jordan elimination over nested lists. Each
    number of the steps is a one-row CTE."""
    counts = ["crit_kw_count", "high_kw_count", "med_kw_count", "low_kw_count", "esc_phrase_count", "negation_count"]
    xs = ["1", *counts, "resolution_hours / 24"]
    for c, values in (("channel", CHANNELS), ("ticket_type", TICKET_TYPES)):
        xs += [f"CAST({c} = {lit(v)} AS INTEGER)" for v in sorted(values)[1:]]
    n = len(xs)
    parts = [_split_sql().replace("SELECT ticket_id, mismatch_label,", "SELECT ticket_id, mismatch_label, split_x AS x,", 1)
             .replace("FROM (SELECT ticket_id, mismatch_label,", "FROM (SELECT ticket_id, mismatch_label, [" + ", ".join(f"CAST({x} AS DOUBLE)" for x in xs) + "] AS split_x,", 1)
             .replace("sp AS (", "sp AS MATERIALIZED (", 1),
             """cw AS MATERIALIZED (SELECT mismatch_label, CAST(sum(count(*)) OVER () AS DOUBLE) / (2 * count(*)) AS w FROM sp WHERE split = 'train' GROUP BY 1),
tw AS MATERIALIZED (SELECT sum(w) AS total FROM sp JOIN cw USING (mismatch_label) WHERE split = 'train')"""]

    def step(name: str, start: str, ridge: float) -> None:
        """CTE ``name``: weights ``b`` one step from those of ``start``, and their macro F1."""
        parts.append(f"""{name}_p AS MATERIALIZED (
  SELECT w, x, p - mismatch_label AS e, p * (1 - p) AS v FROM (
    SELECT mismatch_label, w, x, 1 / (1 + exp(-list_dot_product(x, b))) AS p FROM sp JOIN cw USING (mismatch_label), {start} WHERE split = 'train')),
{name}_h AS MATERIALIZED (
  SELECT list(row ORDER BY j) AS m FROM (
    SELECT j, list(s ORDER BY k) AS row FROM (
      SELECT j, k, CASE WHEN k <= {n} THEN sum(w * v * x[j] * x[least(k, {n})]) / any_value(total) + CASE WHEN j = k THEN {ridge!r} ELSE 0 END
                        ELSE sum(w * e * x[j]) / any_value(total) + {ridge!r} * any_value(b[j]) END AS s
      FROM {name}_p, tw, {start}, range(1, {n + 1}) r(j), range(1, {n + 2}) q(k) GROUP BY j, k) GROUP BY j))""")
        last = f"{name}_h"
        for k in range(1, n + 1):
            parts.append(f"""{name}_{k} AS MATERIALIZED (SELECT list_transform(m, lambda r, i: CASE WHEN i = {k} THEN list_transform(r, lambda v: v / m[{k}][{k}])
  ELSE list_transform(r, lambda v, j: v - r[{k}] * m[{k}][j] / m[{k}][{k}]) END) AS m FROM {last})""")
            last = f"{name}_{k}"
        parts.append(f"""{name}_b AS MATERIALIZED (SELECT list_transform(b, lambda v, i: v - m[i][{n + 1}]) AS b FROM {start}, {last}),
{name} AS MATERIALIZED (
  SELECT any_value(b) AS b, coalesce(tn / nullif(tn + (fn + fp) / CAST(2 AS DOUBLE), 0), 0) / 2 + coalesce(tp / nullif(tp + (fn + fp) / CAST(2 AS DOUBLE), 0), 0) / 2 AS f1
  FROM (SELECT count(*) FILTER (y = 1 AND q) AS tp, count(*) FILTER (y = 0 AND q) AS fp, count(*) FILTER (y = 1 AND NOT q) AS fn, count(*) FILTER (y = 0 AND NOT q) AS tn
        FROM (SELECT mismatch_label AS y, list_dot_product(x, b) >= 0 AS q FROM sp, {name}_b WHERE split = 'val')), {name}_b GROUP BY tp, fp, fn, tn)""")

    parts.append(f"c_start AS MATERIALIZED (SELECT CAST({[0.0] * n} AS DOUBLE[]) AS b)")
    start = "c_start"
    for c, ridge in enumerate((0.1, 0.001)):
        for e in range(1, 5):
            step(f"c{c}e{e}", start if e == 1 else f"c{c}e{e - 1}", ridge)
        rows = " UNION ALL ".join(f"SELECT {c} AS candidate, {e} AS epoch, CAST({ridge!r} AS DOUBLE) AS ridge, f1, b FROM c{c}e{e}" for e in range(1, 5))
        # the fourth epoch is run unless two epochs have not risen above the first
        parts.append(f"""c{c}_all AS MATERIALIZED ({rows}),
c{c}_run AS MATERIALIZED (SELECT * FROM c{c}_all WHERE epoch <= 3 OR (SELECT max(round(f1, 12)) FILTER (epoch IN (2, 3)) > max(round(f1, 12)) FILTER (epoch = 1) FROM c{c}_all)),
c{c}_best AS MATERIALIZED (SELECT * FROM c{c}_run ORDER BY round(f1, 12) DESC, epoch LIMIT 1)""")
        start = f"c{c}_best"
    parts.append("""runs AS MATERIALIZED (SELECT * FROM c0_run UNION ALL SELECT * FROM c1_run),
chosen AS MATERIALIZED (SELECT * FROM runs ORDER BY round(f1, 12) DESC, candidate, epoch LIMIT 1),
scored AS MATERIALIZED (SELECT ticket_id, mismatch_label, candidate, epoch, list_dot_product(x, b) AS z FROM sp, chosen WHERE split = 'test')""")
    return with_audit(", " + ",\n".join(parts) + "\n" + tail)


def oracle_sql() -> dict[str, str]:
    wide = case_map(f"lower(trim(priority_alt, {WS}))", WIDE_PRIORITY)
    strict = case_map(f"lower(trim(priority_alt, {WS}))", STRICT_PRIORITY)
    thresholds = " UNION ALL ".join(
        f"SELECT {lit(n)} AS metric, round(CAST({n} AS DOUBLE), 6) AS value, CAST({t} AS DOUBLE) AS threshold, "
        f"{n} >= {t} AS passed FROM mr" for n, t in THRESHOLDS)
    app_hours = "resolution_hours IS NOT NULL AND resolution_hours <> 0"
    app_analysis = (f"CASE WHEN mismatch_label = 1 THEN printf({lit(D.ANALYSIS_APP)}, crit_kw_count, "
                    f"esc_phrase_count, inferred_severity_label, priority_norm, "
                    f"CASE WHEN severity_delta > 0 THEN 'under-represents' ELSE 'over-represents' END, "
                    f"abs(severity_delta)) ELSE {lit(D.ANALYSIS_APP_CONSISTENT)} END")
    cli_analysis = (f"printf({lit(D.ANALYSIS_CLI)}, crit_kw_count, esc_phrase_count, inferred_severity_label, "
                    f"CASE WHEN severity_delta > 0 THEN 'exceeds' ELSE 'falls below' END, priority_norm, "
                    f"abs(severity_delta))")
    kw_in_text = "list_filter(top_kw, lambda k: contains(lower(full_text), lower(k)))"
    q = {
        "clean_tickets": with_tickets("""
SELECT ticket_id, subject, description, full_text, priority_raw, priority_norm, priority_score,
       channel, ticket_type, resolution_hours FROM imp"""),
        "priority_wide": with_tickets(f"""
SELECT ticket_id, priority_alt, coalesce({wide}, 'Medium') AS priority_norm,
       coalesce({wide}, trim(priority_alt, {WS})) AS priority_kept,
       coalesce({strict}, 'Medium') AS priority_strict,
       {score_of(f"coalesce({wide}, 'Medium')")} AS priority_score FROM raw"""),
        "ticket_ids": """
SELECT o_orderkey AS order_key, row_number() OVER () - 1 AS pos,
       printf('TKT_%05d', row_number() OVER () - 1) AS ticket_id FROM orders""",
        "hours_coerced": _hours_coerced_sql(),
        "blank_rejects": with_tickets(f"""
SELECT ticket_id, description FROM raw WHERE trim(coalesce(description, ''), {WS}) = ''"""),
        "text_signal_core": _text_signal_sql(CORE),
        "text_signal_full": _text_signal_sql(FULL),
        "text_signal_app": _text_signal_sql(APP),
        "text_signal_baseline": _text_signal_sql(BASELINE),
        "document_keyword_hits": _document_sql(),
        "hours_baseline": with_tickets(f"""
SELECT bl.n, bl.hours_median, {r6('st.hours_mean')} AS hours_mean, {r6('st.hours_std')} AS hours_std FROM bl, st"""),
        "time_signal": with_audit(f"""
SELECT ticket_id, resolution_hours, {r6('rt_zscore')} AS rt_zscore, rt_severity FROM au"""),
        "audited_tickets": with_audit(f"""
SELECT ticket_id, priority_norm, priority_score, resolution_hours, crit_kw_count, high_kw_count,
       esc_phrase_count, negation_count, nlp_severity, rt_severity, {r6('fused_score')} AS fused_score,
       inferred_severity, inferred_severity_label, severity_delta, mismatch_label, mismatch_type,
       top_keywords FROM au"""),
        "rule_predictions": with_audit("""
SELECT ticket_id, priority_norm AS assigned_priority, inferred_severity_label AS inferred_severity,
       mismatch_label, mismatch_type, severity_delta, CAST(0.8 AS DOUBLE) AS confidence FROM au""",
                                       mode="nlp"),
        "rule_predictions_app": with_audit("""
SELECT ticket_id, priority_norm AS assigned_priority, inferred_severity_label AS inferred_severity,
       mismatch_label, mismatch_type, severity_delta,
       CAST(CASE mismatch_label WHEN 1 THEN 0.75 ELSE 0.8 END AS DOUBLE) AS confidence FROM au""", mode="nlp"),
        "model_input": with_audit(f"""
SELECT ticket_id, printf({lit(MODEL_INPUT_FORMAT)}, coalesce(channel, 'unknown'),
       CASE WHEN resolution_hours IS NULL THEN 'unknown' ELSE printf('%.1f hours', resolution_hours) END,
       coalesce(ticket_type, 'unknown'), coalesce(full_text, '')) AS model_input FROM au"""),
        "ablation": with_audit(f"""
, r AS (SELECT avg(CAST(abs(nlp_severity - priority_score) >= 2 AS DOUBLE)) * 100 AS a,
               avg(CAST(abs(rt_severity - priority_score) >= 2 AS DOUBLE)) * 100 AS b,
               avg(CAST(mismatch_label AS DOUBLE)) * 100 AS f FROM au)
SELECT 'NLP only (A)' AS signal, '100%' AS weight_used, {r6('a')} AS mismatch_rate FROM r
UNION ALL SELECT 'Resol. Time only (B)', '100%', {r6('b')} FROM r
UNION ALL SELECT 'Fused (A+B)', '60% / 40%', {r6('f')} FROM r"""),
        "signal_agreement": with_audit(f"""
SELECT {r6('avg(CAST(nlp_severity = rt_severity AS DOUBLE))')} AS agreement FROM au"""),
        "value_counts_priority": with_tickets("SELECT priority_norm, count(*) AS n FROM tk GROUP BY 1"),
        "value_counts_type": with_audit("SELECT mismatch_type, count(*) AS n FROM au GROUP BY 1"),
        "null_counts": _null_counts_sql(),
        "mismatch_rate_by_priority": with_audit(f"""
SELECT priority_norm, count(*) AS n, {r6('avg(CAST(mismatch_label AS DOUBLE)) * 100')} AS mismatch_rate
FROM au GROUP BY 1"""),
        "mismatch_summary": with_audit(f"""
SELECT count(*) AS n, CAST(sum(mismatch_label) AS BIGINT) AS mismatches,
       {r6('avg(CAST(mismatch_label AS DOUBLE)) * 100')} AS mismatch_rate FROM au"""),
        "delta_histogram": with_audit("""
, c AS (SELECT severity_delta, count(*) AS n FROM au GROUP BY 1)
SELECT CAST(r.d AS INTEGER) AS severity_delta, coalesce(c.n, 0) AS n
FROM range(-4, 5) r(d) LEFT JOIN c ON c.severity_delta = r.d"""),
        "hours_histogram": with_tickets(f"""
, v AS (SELECT resolution_hours AS x FROM tk WHERE resolution_hours IS NOT NULL),
  rg AS (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
                CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM v),
  b AS (SELECT CAST(least(floor(CAST(40.0 AS DOUBLE) * (x - lo) / (hi - lo)) + 1, 40) AS INTEGER) AS bin
        FROM v, rg),
  c AS (SELECT bin, count(*) AS n FROM b GROUP BY 1)
SELECT CAST(r.i AS INTEGER) AS bin,
       {r6('lo + (r.i - 1) * ((hi - lo) / CAST(40.0 AS DOUBLE))')} AS bin_lo,
       {r6('lo + r.i * ((hi - lo) / CAST(40.0 AS DOUBLE))')} AS bin_hi,
       coalesce(c.n, 0) AS n
FROM range(1, 41) r(i) CROSS JOIN rg LEFT JOIN c ON c.bin = r.i"""),
        "hours_describe": with_audit(f"""
SELECT count(resolution_hours) AS "count", {r6('avg(resolution_hours)')} AS mean,
       {r6('stddev_samp(resolution_hours)')} AS std, {r6('min(resolution_hours)')} AS "min",
       {r6('quantile_cont(resolution_hours, 0.25)')} AS q25, {r6('quantile_cont(resolution_hours, 0.5)')} AS q50,
       {r6('quantile_cont(resolution_hours, 0.75)')} AS q75, {r6('max(resolution_hours)')} AS "max" FROM au"""),
        "kpis": with_audit(f"""
SELECT count(*) AS total, count(*) FILTER (WHERE mismatch_type <> 'Consistent') AS mismatches,
       count(*) FILTER (WHERE mismatch_type = 'Hidden Crisis') AS hidden_crises,
       count(*) FILTER (WHERE mismatch_type = 'False Alarm') AS false_alarms,
       {r6("CAST(count(*) FILTER (WHERE mismatch_type <> 'Consistent') AS DOUBLE) / greatest(count(*), 1) * 100")}
         AS mismatch_share FROM au"""),
        "priority_crosstab": with_audit("SELECT priority_norm AS assigned_priority, " + ", ".join(
            f"count(*) FILTER (WHERE inferred_severity_label = '{lv}') AS \"{lv}\"" for lv in LEVELS)
            + " FROM au GROUP BY 1"),
        "top_keywords": with_audit(flagged_evidence_ctes() + """
SELECT value, count(*) AS n FROM ev
WHERE signal = 'keyword' AND value IS NOT NULL AND lower(value) <> 'nan' AND length(value) > 2
GROUP BY value ORDER BY n DESC, value ASC LIMIT 15"""),
        "class_weights": with_audit(f"""
, g AS (SELECT mismatch_label, count(*) AS n FROM au GROUP BY 1),
  t AS (SELECT sum(n) AS n_total, count(*) AS k FROM g)
SELECT mismatch_label, n, {r6('CAST(n_total AS DOUBLE) / (k * n)')} AS weight FROM g, t"""),
        "imbalance": with_audit(f"""
, c AS (SELECT count(*) FILTER (WHERE mismatch_label = 0) AS n_consistent,
               count(*) FILTER (WHERE mismatch_label = 1) AS n_mismatch FROM au)
SELECT n_consistent, n_mismatch,
       {r6('CAST(n_mismatch AS DOUBLE) / (n_consistent + n_mismatch)')} AS share_mismatch,
       {r6('CAST(n_consistent AS DOUBLE) / greatest(n_mismatch, 1)')} AS ratio FROM c"""),
        "stratified_split": with_audit(", " + _split_sql() + "\nSELECT ticket_id, mismatch_label, split FROM sp"),
        "split_rates": with_audit(", " + _split_sql() + f"""
SELECT split, count(*) AS n, {r6('avg(CAST(mismatch_label AS DOUBLE))')} AS mismatch_rate FROM sp GROUP BY 1"""),
        "confusion": with_audit(_metric_ctes() + """
SELECT y.label, count(lp.label) FILTER (WHERE prediction = 0) AS pred_0,
       count(lp.label) FILTER (WHERE prediction = 1) AS pred_1
FROM (VALUES (0), (1)) y(label) LEFT JOIN lp ON lp.label = y.label GROUP BY 1"""),
        "classification_metrics": with_audit(_metric_ctes() + "\nSELECT * FROM mt"),
        "classification_report": with_audit(_metric_ctes() + f"""
SELECT 'Consistent' AS class_name, {r6('precision0')} AS precision, {r6('recall0')} AS recall,
       {r6('f1_0')} AS f1, support0 AS support FROM pf
UNION ALL SELECT 'Mismatch', {r6('precision1')}, {r6('recall1')}, {r6('f1_1')}, support1 FROM pf
UNION ALL SELECT 'macro avg', {r6('(precision0 + precision1) / 2')}, {r6('(recall0 + recall1) / 2')},
       {r6('(f1_0 + f1_1) / 2')}, support0 + support1 FROM pf
UNION ALL SELECT 'weighted avg',
       {r6('coalesce((precision0 * support0 + precision1 * support1) / nullif(CAST(support0 + support1 AS DOUBLE), 0), 0)')},
       {r6('coalesce((recall0 * support0 + recall1 * support1) / nullif(CAST(support0 + support1 AS DOUBLE), 0), 0)')},
       {r6('coalesce((f1_0 * support0 + f1_1 * support1) / nullif(CAST(support0 + support1 AS DOUBLE), 0), 0)')},
       support0 + support1 FROM pf"""),
        "thresholds": with_audit(_metric_ctes() + "\n" + thresholds),
        "dossier_evidence": with_audit(flagged_evidence_ctes() + """
SELECT ticket_id, pos, signal, value, weight, interpretation FROM ev"""),
        "dossier_evidence_cli": with_audit(_evidence_sql("fl", f"printf('%.1f hours', resolution_hours)", D.TIME_TEXT_CLI, "TRUE"), mode="nlp"),
        "dossier_evidence_app": with_audit(_evidence_sql("au", "CAST(resolution_hours AS VARCHAR) || ' hours'", D.TIME_TEXT_APP, app_hours), mode="nlp"),
        "dossier_grounding": with_audit(flagged_evidence_ctes() + """
, t AS (SELECT ticket_id, lower(full_text || ' ' || subject) AS text, CAST(ticket_id AS BIGINT) AS k FROM au WHERE CAST(ticket_id AS BIGINT) % 14 <> 5),
tx AS (SELECT ticket_id, text FROM t UNION SELECT ticket_id, 'reopened: ' || text FROM t WHERE k % 9 = 2),
nt AS (SELECT ticket_id, count(*) AS n FROM tx GROUP BY 1),
hold AS (SELECT DISTINCT ticket_id, w FROM (SELECT ticket_id, unnest(regexp_extract_all(text, '[a-z0-9]+')) AS w FROM tx)),
cand AS (SELECT ticket_id, len(ks) AS nk, unnest(ks) AS term, generate_subscripts(ks, 1) AS pos
         FROM (SELECT ticket_id, list_concat(kws, CASE WHEN CAST(ticket_id AS BIGINT) % 3 = 0 THEN ['open the archive'] ELSE [] END) AS ks FROM kwl)),
loose AS (SELECT * FROM cand c WHERE length(term) > 3 AND NOT EXISTS (SELECT 1 FROM tx WHERE tx.ticket_id = c.ticket_id AND contains(tx.text, c.term))),
words AS (SELECT DISTINCT term, unnest(regexp_extract_all(term, '[a-z0-9]+')) AS w FROM (SELECT DISTINCT term FROM loose)),
hits AS (SELECT term, ticket_id FROM words JOIN hold USING (w) GROUP BY term, ticket_id HAVING count(*) = (SELECT count(*) FROM words x WHERE x.term = words.term)),
oth AS (SELECT l.ticket_id, l.pos, l.term, count(h.ticket_id) AS n FROM loose l LEFT JOIN hits h ON h.term = l.term AND h.ticket_id <> l.ticket_id GROUP BY ALL),
msg AS (SELECT ticket_id, string_agg(printf('Ungrounded keyword: "%s" (in %d other tickets)', term, n), ' ; ' ORDER BY pos) AS m FROM oth GROUP BY 1)
SELECT f.ticket_id, coalesce(nt.n, 0) AS n_texts,
       concat_ws(' ; ', CASE WHEN nt.n IS NULL THEN 'No ticket text' WHEN nt.n > 1 THEN printf('Ambiguous ticket id: %d texts', nt.n) END, msg.m) AS messages
FROM fl f LEFT JOIN nt USING (ticket_id) LEFT JOIN msg USING (ticket_id)"""),
        "dossier_violations": with_audit(flagged_evidence_ctes() + """
, k AS (SELECT ticket_id, severity_delta, CAST(ticket_id AS BIGINT) % 6 AS kind FROM kwl)
SELECT ticket_id,
       CASE kind WHEN 2 THEN 'Missing key: confidence' WHEN 4 THEN 'Hallucinated keyword evidence: "zeppelin"'
            WHEN 5 THEN array_to_string(list_transform(['ticket_id', 'assigned_priority', 'inferred_severity', 'mismatch_type', 'severity_delta',
                        'feature_evidence', 'constraint_analysis', 'confidence'], lambda x: 'Missing key: ' || x), ' ; ') ELSE '' END AS violations,
       kind NOT IN (2, 4, 5) AS valid, CASE WHEN kind <> 5 THEN severity_delta END AS severity_delta,
       CASE WHEN kind NOT IN (1, 2, 5) THEN CAST(0.8 AS DOUBLE) END AS confidence FROM k"""),
        "dossier_text": with_audit(flagged_evidence_ctes() + f"""
SELECT ticket_id, priority_norm AS assigned_priority, inferred_severity_label AS inferred_severity,
       CASE WHEN severity_delta > 0 THEN 'Hidden Crisis' ELSE 'False Alarm' END AS mismatch_type,
       severity_delta, {notebook_analysis()} AS constraint_analysis, CAST(0.8 AS DOUBLE) AS confidence,
       CAST(nk + CAST(esc_phrase_count > 0 AS INTEGER) + CAST(negation_count > 0 AS INTEGER) + 2 AS INTEGER)
         AS n_evidence
FROM kwl"""),
        "dossier_text_cli": with_audit(flagged_evidence_ctes() + f"""
SELECT ticket_id, CASE WHEN severity_delta > 0 THEN 'Hidden Crisis' ELSE 'False Alarm' END AS mismatch_type,
       severity_delta, {cli_analysis} AS constraint_analysis, CAST(nk + 1 AS INTEGER) AS n_evidence FROM kwl""",
                                       mode="nlp"),
        "dossier_text_app": with_audit(f"""
SELECT ticket_id, mismatch_type, {app_analysis} AS constraint_analysis,
       CAST(CASE mismatch_label WHEN 1 THEN 0.75 ELSE 0.8 END AS DOUBLE) AS confidence,
       CAST(len({kw_in_text}) + CAST({app_hours} AS INTEGER) AS INTEGER) AS n_evidence FROM au""", mode="nlp"),
        "dossier_validation": with_audit(flagged_evidence_ctes() + """
, vv AS (SELECT ticket_id, list_transform(
           list_filter(list_append(kws, channel),
                       lambda v: length(lower(v)) > 3
                                 AND NOT contains(lower(full_text || ' ' || subject), lower(v))),
           lambda v: 'Hallucinated keyword evidence: "' || lower(v) || '"') AS viol FROM kwl)
SELECT ticket_id, CAST(len(viol) AS INTEGER) AS n_violations, array_to_string(viol, ' ; ') AS violations,
       len(viol) = 0 AS valid FROM vv"""),
        "dossier_first_n": with_audit("""
SELECT ticket_id, order_key, mismatch_type, severity_delta FROM au WHERE mismatch_label = 1
ORDER BY order_key LIMIT 50"""),
        "dossiers_pending": with_audit("""
SELECT ticket_id, mismatch_type FROM au
WHERE mismatch_label = 1 AND order_key % 3 <> 0 AND order_key % 5 <> 0"""),
        "prompt_text": with_audit(f"SELECT ticket_id, {prompt_sql()} AS prompt FROM au WHERE mismatch_label = 1"),
        "parsed_response": with_audit(flagged_evidence_ctes() + """
SELECT ticket_id,
       CASE WHEN CAST(ticket_id AS BIGINT) % 4 = 0 THEN NULL
            WHEN severity_delta > 0 THEN 'Hidden Crisis' ELSE 'False Alarm' END AS mismatch_type,
       CASE WHEN CAST(ticket_id AS BIGINT) % 4 = 0 THEN NULL ELSE severity_delta END AS severity_delta,
       CASE WHEN CAST(ticket_id AS BIGINT) % 4 = 0 THEN NULL
            ELSE CAST(nk + CAST(esc_phrase_count > 0 AS INTEGER) + CAST(negation_count > 0 AS INTEGER) + 2
                      AS INTEGER) END AS n_evidence
FROM kwl"""),
        "challenge_scoreboard": (
            f"WITH {tickets_ctes()},{audit_ctes(CORE, 'fused', '')},"
            f"{audit_ctes(BASELINE, 'nlp', 'b_')},{audit_ctes(CORE, 'nlp', 'c_')}\n"
            """SELECT count(*) AS n,
       count(*) FILTER (WHERE b.mismatch_label = t.mismatch_label) AS keyword_correct,
       count(*) FILTER (WHERE c.mismatch_label = t.mismatch_label) AS model_correct
FROM au t JOIN b_au b USING (ticket_id) JOIN c_au c USING (ticket_id)"""),
        "challenge_matches": (
            f"WITH {tickets_ctes()},{audit_ctes(CORE, 'fused', '')},{audit_ctes(BASELINE, 'nlp', 'b_')},"
            """
k AS (SELECT a.ticket_id, CAST(a.ticket_id AS BIGINT) AS k, a.mismatch_label AS t, b.mismatch_label AS b,
             CAST(abs(a.nlp_severity - a.priority_score) >= 2 AS INTEGER) AS m FROM au a JOIN b_au b USING (ticket_id)),
s AS (SELECT ticket_id, CASE WHEN k % 17 <> 4 THEN t END AS t, CASE WHEN k % 11 <> 5 AND k % 7 <> 3 THEN b END AS b, CASE WHEN k % 19 <> 6 THEN m END AS m,
             CAST(k % 17 <> 4 AS BIGINT) AS nt, CASE WHEN k % 11 = 5 THEN 0 WHEN k % 7 = 3 THEN 2 ELSE 1 END AS nk,
             CASE WHEN k % 19 = 6 THEN 0 WHEN k % 13 = 2 THEN 2 ELSE 1 END AS nm FROM k)
SELECT ticket_id, t AS true_label, b AS keyword_pred, m AS model_pred, b = t AS keyword_correct, m = t AS model_correct,
       nt AS n_truth, CAST(nk AS BIGINT) AS n_keyword, CAST(nm AS BIGINT) AS n_model,
       CASE WHEN nk = 2 THEN 'ambiguous' WHEN nt = 0 THEN 'no_truth' WHEN nk = 0 THEN 'no_keyword' WHEN nm = 0 THEN 'no_model'
            WHEN nm = 2 THEN 'repeated' ELSE 'ok' END AS status FROM s WHERE nt + nk + nm > 0"""),
        "challenge_report": (
            f"WITH {tickets_ctes()},{audit_ctes(CORE, 'fused', '')},{audit_ctes(BASELINE, 'nlp', 'b_')},{audit_ctes(CORE, 'nlp', 'c_')}\n"
            """SELECT t.ticket_id, t.mismatch_label AS true_label, t.mismatch_type AS true_mismatch_type, b.mismatch_label AS keyword_pred,
       c.mismatch_label AS model_pred, b.mismatch_label = t.mismatch_label AS keyword_correct, c.mismatch_label = t.mismatch_label AS model_correct
FROM au t JOIN b_au b USING (ticket_id) JOIN c_au c USING (ticket_id)"""),
        "challenge_bonus": (
            f"WITH {tickets_ctes()},{audit_ctes(CORE, 'fused', '')},{audit_ctes(BASELINE, 'nlp', 'b_')},{audit_ctes(CORE, 'nlp', 'c_')}\n"
            """SELECT count(*) AS n, count(*) FILTER (WHERE b.mismatch_label = t.mismatch_label) AS keyword_correct,
       count(*) FILTER (WHERE c.mismatch_label = t.mismatch_label) AS model_correct,
       count(*) FILTER (WHERE c.mismatch_label = t.mismatch_label) >= 7 AS bonus_earned
FROM au t JOIN b_au b USING (ticket_id) JOIN c_au c USING (ticket_id)"""),
        "classifier_predictions": _newton_sql("""
SELECT ticket_id, mismatch_label, CAST(z >= 0 AS INTEGER) AS prediction,
       round(greatest(1 / (1 + exp(-z)), 1 - 1 / (1 + exp(-z))), 4) AS confidence, candidate, epoch FROM scored"""),
        "classifier_versions": _newton_sql(f"""
SELECT r.candidate, r.epoch, r.ridge, {r6('r.f1')} AS macro_f1, r.candidate = c.candidate AND r.epoch = c.epoch AS chosen FROM runs r, chosen c"""),
        "classifier_thresholds": _newton_sql(", " + _metric_ctes(
            "SELECT mismatch_label AS label, CAST(z >= 0 AS INTEGER) AS prediction FROM scored").lstrip(",\n") + "\n" + thresholds),
        "stream_scored": with_audit("""
SELECT ticket_id, nlp_severity, rt_severity, inferred_severity, mismatch_label, mismatch_type
FROM au WHERE has_event"""),
        "stream_arrivals": _stream_arrivals_sql(),
        "stream_daily_counts": _stream_daily_sql(),
    }
    return q
