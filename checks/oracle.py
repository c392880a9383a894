"""The registered queries again as DuckDB SQL, written independently of the Spark plans."""

from __future__ import annotations

import re

from mailgrade import phrases as P
from mailgrade.operators import selection
from mailgrade.operators.features import COMPACT, META, NARROW, URGENCY

# Word borders over all letters, marks and digits; \\b knows ASCII only.
_EDGE_BEFORE, _EDGE_AFTER = r"(?:^|[^\p{L}\p{M}\p{N}_])", r"(?:$|[^\p{L}\p{M}\p{N}_])"

MAIL = """mail AS (
SELECT d.doc_id AS id,
 '<' || CAST(d.doc_id AS STRING) || '@' || d.source || '.example>' AS message_id,
 CASE d.doc_id % 11 WHEN 0 THEN 'ceo' WHEN 1 THEN 'director' WHEN 2 THEN 'noreply'
   WHEN 3 THEN 'no-reply'
   ELSE 'user' || COALESCE(CAST(e.user_id AS STRING), '0') END || '@' || d.source || '.example'
   AS sender,
 CASE d.doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'a@x.example' WHEN 2 THEN 'a@x.example, b@y.example'
   ELSE 'a@x.example, b@y.example, c@z.example' END AS recipients,
 CASE WHEN d.doc_id % 5 = 0 THEN 'team@x.example' ELSE '' END AS cc,
 CASE WHEN d.doc_id % 13 = 0 THEN 'audit@x.example' ELSE '' END AS bcc,
 CASE d.doc_id % 16
   WHEN 0 THEN 'URGENT: gateway outage!!!' WHEN 1 THEN 'Security alert on host'
   WHEN 2 THEN 'Please review the draft?' WHEN 3 THEN 'Re: budget talks'
   WHEN 4 THEN 'Re: Re: budget talks' WHEN 5 THEN 'Fwd: article of note'
   WHEN 6 THEN 'FW: FW: photo album' WHEN 7 THEN 'Weekly digest'
   WHEN 8 THEN 'Unsubscribe from promo list' WHEN 9 THEN 'Viva next year'
   WHEN 10 THEN 'Viva next year, reply asap' WHEN 11 THEN 'Lunch menu'
   WHEN 12 THEN 'Font files' WHEN 13 THEN '' WHEN 14 THEN 'Parking lots'
   ELSE 'Deadline by friday' END AS subject,
 d.text AS body, e.ts AS date,
 CASE d.doc_id % 17 WHEN 0 THEN 'urgent' WHEN 1 THEN 'spam' WHEN 2 THEN 'junk/old'
   WHEN 3 THEN 'newsletter' WHEN 4 THEN 'notifications' ELSE 'inbox' END AS folder
FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id)"""

MAIL_DUP = """mail_dup AS (
SELECT m.*, 0 AS seq FROM mail m UNION ALL SELECT m.*, 1 AS seq FROM mail m WHERE m.id % 10 = 0)"""

MAIL_DIRTY = """mail_dirty AS (
SELECT m.id, m.message_id,
 CASE WHEN m.id % 6 = 0 THEN '' ELSE m.sender END AS sender,
 CASE WHEN m.id % 3 = 0 THEN '' ELSE m.subject END AS subject,
 CASE WHEN m.id % 7 = 0 THEN '' ELSE m.body END AS body,
 CASE m.id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'low' WHEN 3 THEN 'bogus'
   ELSE NULL END AS priority
FROM mail m)"""

MAIL_HEADERS = """mail_headers AS (
SELECT m.id,
 CASE WHEN m.recipients = '' THEN 'undisclosed-recipients:;'
   ELSE '"Team, All" <' || replace(m.recipients, ', ', '>, <') || '>' END AS to_header,
 CASE m.id % 3 WHEN 0 THEN 'Mon, 14 May 2001 16:39:00 -0700 (PDT)' WHEN 1 THEN '2026-04-23T15:21'
   ELSE 'not a date' END AS date_header
FROM mail m)"""

BLANK = (
    r"[\s\x0B\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
NON_BLANK = BLANK.replace("[", "[^", 1)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(phrases) -> str:
    return "[" + ", ".join(_text(p) for p in phrases) + "]"


def _hits(text: str, phrases) -> str:
    return f"len(list_filter({_list(phrases)}, lambda k: contains({text}, k)))"


def _any(text: str, phrases) -> str:
    return f"{_hits(text, phrases)} > 0"


def _name(priority: str) -> str:
    return (
        f"CASE {priority} WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'normal' "
        "WHEN 3 THEN 'low' END"
    )


def _strip(value: str) -> str:
    return f"regexp_replace({value}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def _count(value: str, pattern: str) -> str:
    return f"len(regexp_extract_all({value}, '{pattern}'))"


def _fence(ctes: str) -> str:
    """Have each step computed once; merged steps repeat the phrase tests many times over."""
    return re.sub(r"(?m)^(\w+) AS \(", r"\1 AS MATERIALIZED (", ctes)


def _with(body: str, *ctes: str) -> str:
    return "WITH " + _fence(",\n".join((MAIL, *ctes))) + "\n" + body


def _whole(title: str) -> str:
    return rf"regexp_matches(lower(sender), '\b{title}\b')"


def _labelled(name: str = "labelled", source: str = "mail", csuite: str | None = None) -> str:
    csuite = csuite or _any("lower(sender)", P.CSUITE)
    return f"""{name} AS (
SELECT *, CAST(CASE
  WHEN {_any('t', P.CRITICAL)} OR contains(lower(folder), 'urgent')
    OR contains(lower(folder), 'critical') OR {csuite} THEN 0
  WHEN {_any('t', P.HIGH)} THEN 1
  WHEN {_any('t', P.LOW)} OR contains(lower(folder), 'spam') OR contains(lower(folder), 'junk')
    OR starts_with(lower(sender), 'no-reply') OR starts_with(lower(sender), 'noreply')
    OR contains(lower(folder), 'newsletter') OR contains(lower(folder), 'notification') THEN 3
  ELSE 2 END AS INTEGER) AS priority
FROM (SELECT *, lower(subject) || ' ' || substr(lower(body), 1, 500) AS t FROM {source}))"""


def _argmax(a: str, b: str, c: str, d: str) -> str:
    return (
        f"CAST(CASE WHEN {a} >= {b} AND {a} >= {c} AND {a} >= {d} THEN 0 "
        f"WHEN {b} >= {c} AND {b} >= {d} THEN 1 WHEN {c} >= {d} THEN 2 ELSE 3 END AS INTEGER)"
    )


P4 = ("p0", "p1", "p2", "p3")


def _scored(name: str, source: str, text: str) -> str:
    """Text scores s0..s3, shares p0..p3 and the rule class."""
    half, third = "CAST(0.5 AS DOUBLE)", "CAST(0.3 AS DOUBLE)"
    damp = "CASE WHEN is_far THEN CAST(0.15 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END"
    return f"""{name}_raw AS (
SELECT *, lower({text}) AS rt FROM {source}),
{name}_hits AS (
SELECT *, {_hits('rt', P.CRITICAL)} AS n_critical, {_hits('rt', P.HIGH)} AS n_high,
 {_hits('rt', P.LOW)} AS n_low,
 {_any('rt', P.DISTANT)} AND NOT {_any('rt', P.NEAR)} AS is_far FROM {name}_raw),
{name}_scores AS (
SELECT *,
 (2.0 * n_critical + CASE WHEN length(rt) - length(replace(rt, '!', '')) > 2
   THEN 1.0 ELSE 0.0 END)::DOUBLE * {damp} AS s0,
 (n_high::DOUBLE + CASE WHEN contains(rt, '?') THEN {half} ELSE 0 END
   + CASE WHEN starts_with(rt, 're:') THEN {third} ELSE 0 END) * {damp} AS s1,
 CASE WHEN is_far THEN CAST(2.8 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END AS s2,
 n_low::DOUBLE + CASE WHEN starts_with(rt, 'fw:') OR starts_with(rt, 'fwd:')
   THEN 1.0 ELSE 0.0 END AS s3
FROM {name}_hits),
{name}_shares AS (
SELECT *, s0 / (s0 + s1 + s2 + s3) AS p0, s1 / (s0 + s1 + s2 + s3) AS p1,
 s2 / (s0 + s1 + s2 + s3) AS p2, s3 / (s0 + s1 + s2 + s3) AS p3 FROM {name}_scores),
{name} AS (
SELECT *, {_argmax(*P4)} AS rule_class FROM {name}_shares)"""


RULE_TEXT = "subject || ' ' || substr(body, 1, 500) || ' ' || sender"


def _classified(name: str = "ruled", source: str = "mail") -> str:
    raised = "(p0 + p1 + CAST(0.3 AS DOUBLE) + p2 + p3)"
    return _scored(f"{name}_text", source, RULE_TEXT) + f""",
{name}_up AS (
SELECT *, {_any('lower(sender)', P.CSUITE)} AND rule_class > 1 AS up FROM {name}_text),
{name}_lifted AS (
SELECT * EXCLUDE (p0, p1, p2, p3),
 CASE WHEN up THEN p0 / {raised} ELSE p0 END AS p0,
 CASE WHEN up THEN (p1 + CAST(0.3 AS DOUBLE)) / {raised} ELSE p1 END AS p1,
 CASE WHEN up THEN p2 / {raised} ELSE p2 END AS p2,
 CASE WHEN up THEN p3 / {raised} ELSE p3 END AS p3
FROM {name}_up),
{name} AS (
SELECT * EXCLUDE (p0, p1, p2, p3, rule_class),
 CASE WHEN junk THEN CAST(0.02 AS DOUBLE) ELSE p0 END AS p0,
 CASE WHEN junk THEN CAST(0.03 AS DOUBLE) ELSE p1 END AS p1,
 CASE WHEN junk THEN CAST(0.05 AS DOUBLE) ELSE p2 END AS p2,
 CASE WHEN junk THEN CAST(0.90 AS DOUBLE) ELSE p3 END AS p3,
 CASE WHEN junk THEN 3 WHEN up THEN {_argmax(*P4)} ELSE rule_class END::INTEGER AS rule_class
FROM (SELECT *, contains(lower(folder), 'spam') OR contains(lower(folder), 'junk') AS junk
  FROM {name}_lifted))"""


def _planning(text_of: str = "") -> str:
    text = f"lower({text_of}subject || ' ' || substr({text_of}body, 1, 2000))"
    return f"({_any(text, P.DISTANT)} AND NOT {_any(text, P.NEAR)})"


def _downgraded(name: str, source: str, pred: str = "prediction") -> str:
    """Shares p0..p3 and the class after the far-horizon downgrade."""
    target = ("0.02", "0.10", "0.78", "0.10")
    mixed = [f"(0.38::DOUBLE * p{i} + 0.62::DOUBLE * {t}::DOUBLE)" for i, t in enumerate(target)]
    total = " + ".join(mixed)
    shares = ", ".join(
        f"CASE WHEN down THEN {m} / ({total}) ELSE p{i} END AS p{i}" for i, m in enumerate(mixed)
    )
    return f"""{name}_down AS (
SELECT *, {pred} IN (0, 1) AND {_planning()} AS down FROM {source}),
{name}_moved AS (
SELECT * EXCLUDE (p0, p1, p2, p3), {shares} FROM {name}_down),
{name} AS (
SELECT * EXCLUDE ({pred}), CASE WHEN down THEN {_argmax(*P4)} ELSE {pred} END::INTEGER AS {pred}
FROM {name}_moved)"""


STAND_IN = """stand_in AS (
SELECT m.*, CAST(CASE id % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END AS INTEGER) AS prediction,
 CAST(CASE id % 3 WHEN 0 THEN 0.05 WHEN 1 THEN 0.70 ELSE 0.10 END AS DOUBLE) AS m0,
 CAST(CASE id % 3 WHEN 0 THEN 0.15 WHEN 1 THEN 0.20 ELSE 0.75 END AS DOUBLE) AS m1,
 CAST(CASE id % 3 WHEN 0 THEN 0.70 WHEN 1 THEN 0.05 ELSE 0.10 END AS DOUBLE) AS m2,
 CAST(CASE id % 3 WHEN 0 THEN 0.10 WHEN 1 THEN 0.05 ELSE 0.05 END AS DOUBLE) AS m3
FROM mail m)"""

PLAIN_STAND_IN = "plain AS (SELECT *, m0 AS p0, m1 AS p1, m2 AS p2, m3 AS p3 FROM stand_in)"


def _bumped() -> str:
    mixed = [f"(0.55::DOUBLE * m{i} + 0.45::DOUBLE * p{i})" for i in range(4)]
    total = " + ".join(mixed)
    shares = ", ".join(
        f"CASE WHEN raised THEN {m} / ({total}) ELSE m{i} END AS p{i}" for i, m in enumerate(mixed)
    )
    return (
        STAND_IN + ",\n" + _classified("ruled", "stand_in") + f""",
bumped AS (
SELECT * EXCLUDE (p0, p1, p2, p3, prediction), {shares},
 CASE WHEN raised THEN rule_class ELSE prediction END::INTEGER AS prediction
FROM (SELECT *, prediction = 2 AND rule_class IN (0, 1)
  AND CASE rule_class WHEN 0 THEN p0 ELSE p1 END >= 0.45::DOUBLE AS raised FROM ruled))"""
    )


def _round4(prefix: str = "p") -> str:
    return ", ".join(f"round({prefix}{i}, 6) AS p{i}" for i in range(4))


# --- metrics -----------------------------------------------------------------------------------


def _cells(name: str, source: str, by: str = "") -> str:
    """Zero-filled confusion counts of ``source (by, y_true, y_pred)``."""
    lead = f"{by}, " if by else ""
    groups = f"(SELECT DISTINCT {by} FROM {source})" if by else "(SELECT 1)"
    join = " AND ".join([f"c.{b.strip()} = g.{b.strip()}" for b in by.split(",") if by] + [
        "c.y_true = t.i", "c.y_pred = p.i"])
    g = ", ".join(f"g.{b.strip()}" for b in by.split(",")) + ", " if by else ""
    return f"""{name} AS (
SELECT {g}t.i AS y_true, p.i AS y_pred, coalesce(c.n, 0) AS n
FROM {groups} g CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS i) t
CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS i) p
LEFT JOIN (SELECT {lead}y_true, y_pred, count(*) AS n FROM {source} GROUP BY ALL) c ON {join})"""


def _classes(name: str, cells: str, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    return f"""{name} AS (
SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE hits::DOUBLE / predicted END AS precision,
 CASE WHEN support = 0 THEN 0 ELSE hits::DOUBLE / support END AS recall,
 CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * hits::DOUBLE / (support + predicted) END AS f1
FROM (SELECT {lead}class_id, sum(hits)::BIGINT AS hits, sum(support)::BIGINT AS support,
  sum(predicted)::BIGINT AS predicted
 FROM (SELECT {lead}y_true AS class_id, n AS support, 0 AS predicted,
    CASE WHEN y_true = y_pred THEN n ELSE 0 END AS hits FROM {cells}
  UNION ALL SELECT {lead}y_pred, 0, n, 0 FROM {cells}) GROUP BY ALL))"""


def _overall(name: str, classes: str, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""{name} AS (
SELECT {lead}sum(hits)::DOUBLE / sum(support) AS accuracy,
 avg(f1) FILTER (support + predicted > 0) AS macro_f1 FROM {classes} {group})"""


def _judged() -> str:
    return (
        _labelled() + ",\n" + _classified("ruled", "labelled")
        + ",\njudged AS (SELECT id, priority AS y_true, rule_class AS y_pred, p0, p1, p2, p3 FROM ruled)"
    )


JUDGED = (_judged(), _cells("cells", "judged"), _classes("classes", "cells"))

REPORT = f"""report AS (
SELECT {_name('class_id')} AS class, precision, recall, f1, support FROM classes
UNION ALL SELECT 'accuracy', a, a, a, s FROM
 (SELECT sum(hits)::DOUBLE / sum(support) AS a, sum(support)::BIGINT AS s FROM classes)
UNION ALL SELECT 'macro avg', avg(precision) FILTER (support + predicted > 0),
 avg(recall) FILTER (support + predicted > 0), avg(f1) FILTER (support + predicted > 0),
 sum(support)::BIGINT FROM classes
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
 sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT
 FROM classes)"""

LONG_REPORT = "long AS (" + " UNION ALL ".join(
    f"SELECT class, '{m}' AS metric, {m}::DOUBLE AS value FROM report"
    for m in ("precision", "recall", "f1", "support")
) + ")"

ROC = """exploded AS (
SELECT i AS class_id, round(CASE i WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END, 6)
  AS score, (y_true = i)::INT AS hit
FROM judged CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS i)),
steps AS (SELECT class_id, score, sum(hit)::BIGINT AS tp_step, sum(1 - hit)::BIGINT AS fp_step
 FROM exploded GROUP BY ALL),
points AS (SELECT *, sum(tp_step) OVER w AS tp, sum(fp_step) OVER w AS fp,
 sum(tp_step) OVER (PARTITION BY class_id) AS pos, sum(fp_step) OVER (PARTITION BY class_id) AS neg
 FROM steps WINDOW w AS (PARTITION BY class_id ORDER BY score DESC
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

# --- split, folds, candidates ------------------------------------------------------------------


def _ranks(name: str, source: str, label: str) -> str:
    return f"""{name} AS (
SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5(id || '|42'))
   <= floor(count(*) OVER (PARTITION BY {label}) * 0.2::DOUBLE + 0.5::DOUBLE) AS is_test,
 (ntile(5) OVER (PARTITION BY {label} ORDER BY md5(id || '|42')) - 1)::INTEGER AS fold
FROM {source})"""


def _candidates() -> tuple[str, ...]:
    adjusted = _downgraded("adjusted", "bumped")
    return (
        _bumped(), adjusted, _labelled("labelled", "mail"),
        """narrow AS (SELECT l.id, l.priority AS y_true, l.priority AS weak_label,
 b.rule_class AS rule_based, s.prediction AS stand_in, a.prediction AS stand_in_adjusted
FROM labelled l JOIN ruled b USING (id) JOIN stand_in s USING (id) JOIN adjusted a USING (id))""",
        _ranks("placed", "narrow", "y_true"),
        "predictions AS ("
        + " UNION ALL ".join(
            f"SELECT id, y_true, is_test, fold, '{m}' AS model, {m} AS y_pred FROM placed"
            for m in ("weak_label", "rule_based", "stand_in", "stand_in_adjusted")
        )
        + ")",
        "tested AS (SELECT * FROM predictions WHERE is_test)",
        _cells("test_cells", "tested", "model"), _classes("test_classes", "test_cells", "model"),
        _overall("held_out", "test_classes", "model"),
        "folded AS (SELECT * FROM predictions WHERE model <> 'stand_in')",
        _cells("fold_cells", "folded", "model, fold"),
        _classes("fold_classes", "fold_cells", "model, fold"),
        _overall("per_fold", "fold_classes", "model, fold"),
        """training AS (SELECT model, avg(accuracy) AS cv_accuracy_mean,
 stddev_pop(accuracy) AS cv_accuracy_std, avg(macro_f1) AS cv_f1_macro_mean,
 stddev_pop(macro_f1) AS cv_f1_macro_std FROM per_fold GROUP BY model)""",
        """ranked AS (SELECT *, row_number() OVER (ORDER BY suspicious, selection_key DESC,
  coalesce(cv_f1_macro_std, 0), model)::INTEGER AS place
FROM (SELECT *, coalesce(accuracy >= 0.998 AND macro_f1 >= 0.998 AND cv_f1_macro_mean >= 0.998
   AND coalesce(cv_f1_macro_std, 0) < 1e-9, false) AS suspicious,
  coalesce(cv_f1_macro_mean, macro_f1) AS selection_key
 FROM held_out LEFT JOIN training USING (model)))""",
        """decided AS (SELECT model, coalesce(cv_accuracy_mean, accuracy) AS decided_accuracy,
 coalesce(cv_f1_macro_mean, macro_f1) AS decided_macro_f1,
 coalesce(cv_accuracy_mean, accuracy) < 0.75::DOUBLE
  OR coalesce(cv_f1_macro_mean, macro_f1) < 0.65::DOUBLE AS needs_fallback
FROM ranked WHERE place = 1)""",
        f"""published AS (SELECT model, shown_accuracy AS accuracy, shown_f1 AS macro_f1,
 CASE WHEN has_cv THEN {_text(selection.BASIS_CV)} ELSE {_text(selection.BASIS_TEST)} END
  AS performance_basis,
 cv_accuracy_mean, cv_accuracy_std, cv_f1_macro_mean AS cv_macro_f1_mean,
 cv_f1_macro_std AS cv_macro_f1_std, accuracy AS held_out_accuracy, macro_f1 AS held_out_macro_f1,
 nullif(concat_ws(' ',
  CASE WHEN has_cv AND accuracy >= 0.99 AND macro_f1 >= 0.99 AND shown_f1 < 0.92
   THEN {_text(selection.CAVEAT_TEST)} END,
  CASE WHEN has_cv AND cv_f1_macro_std < 1e-9 AND cv_f1_macro_mean >= 0.99
   THEN {_text(selection.CAVEAT_SPREAD)} END,
  CASE WHEN has_cv AND shown_accuracy >= 0.99 AND shown_f1 >= 0.99
   THEN {_text(selection.CAVEAT_EASY)} END), '') AS metrics_caveat
FROM (SELECT *, has_cv_ AS has_cv, CASE WHEN has_cv_ THEN cv_accuracy_mean ELSE accuracy END
   AS shown_accuracy, CASE WHEN has_cv_ THEN cv_f1_macro_mean ELSE macro_f1 END AS shown_f1
 FROM (SELECT *, cv_f1_macro_mean IS NOT NULL AND cv_accuracy_mean IS NOT NULL AS has_cv_
  FROM ranked)))""",
    )


PUBLISHED = ", ".join(
    f"round({c}, 6) AS {c}"
    for c in ("accuracy", "macro_f1", "cv_accuracy_mean", "cv_accuracy_std", "cv_macro_f1_mean",
              "cv_macro_f1_std", "held_out_accuracy", "held_out_macro_f1")
)

# --- features ----------------------------------------------------------------------------------


def _domain(sender: str = "sender") -> str:
    part = rf"lower(regexp_extract({sender}, '@([\w.\-]+)', 1))"
    return f"CASE WHEN {part} = '' THEN 'unknown' ELSE {part} END"


def _bucket(domain: str) -> str:
    return f"(('0x' || substr(md5({domain}), 1, 8))::BIGINT % 32768)::INTEGER"


def _starts(*marks: str) -> str:
    return "(" + " OR ".join(f"starts_with(lower(subject), '{m}')" for m in marks) + ")::INTEGER"


FEATURES = f"""features AS (
SELECT *,
 {_bucket('domain')} AS sender_domain_hash,
 (CASE WHEN recipients = '' THEN 0 ELSE len(string_split(recipients, ',')) END)::INTEGER
   AS recipient_count,
 (trim(cc) <> '')::INTEGER AS has_cc, (trim(bcc) <> '')::INTEGER AS has_bcc,
 coalesce(hour(date), -1)::INTEGER AS hour_of_day,
 coalesce(isodow(date) - 1, -1)::INTEGER AS day_of_week,
 coalesce((isodow(date) IN (6, 7))::INTEGER, 0)::INTEGER AS is_weekend,
 length(subject)::INTEGER AS subject_length, length(body)::INTEGER AS body_length,
 {_count('body', NON_BLANK + '+')}::INTEGER AS word_count,
 {_starts('re:')} AS subject_has_re, {_starts('fw:', 'fwd:')} AS subject_has_fw,
 {_starts('re:')} AS is_reply, {_starts('fw:', 'fwd:')} AS is_forward,
 {_count('lower(subject)', 'fw[d]?:')}::INTEGER AS forward_count,
 ({_hits('st', P.CRITICAL)} + {_hits('st', P.HIGH)})::INTEGER AS urgency_keyword_count,
 ({_hits('st', P.COMPACT_CRITICAL)} + {_hits('st', P.COMPACT_HIGH)})::INTEGER AS urgency_kw_count,
 regexp_matches(st, '{_EDGE_BEFORE}(?:deadline|due date|by [\\p{{L}}\\p{{M}}\\p{{N}}_]+day|by eod|by end of){_EDGE_AFTER}')::INTEGER
   AS has_deadline,
 regexp_matches(st, '{_EDGE_BEFORE}(?:deadline|due date|by [\\p{{L}}\\p{{M}}\\p{{N}}_]+day|by eod){_EDGE_AFTER}')::INTEGER AS short_deadline,
 contains(body, '?')::INTEGER AS has_question,
 (length(body) - length(replace(body, '!', '')))::INTEGER AS exclamation_count,
 greatest({_count('lower(subject)', 're[[:space:]]*:')},
  {_count('lower(subject)', 'fw[d]?[[:space:]]*:')})::INTEGER AS thread_depth,
 {_count('lower(body)', '(attachment|attached|please find|enclosed)')}::INTEGER AS attachment_count
FROM (SELECT *, {_domain()} AS domain, lower(subject || ' ' || substr(body, 1, 500)) AS st
 FROM mail))"""

THREAD = (
    f"CASE WHEN {_strip('c')} <> '' THEN substr(md5({_strip('c')}), 1, 12) "
    "ELSE substr({fallback}, 1, 12) END"
)


def _thread(subject: str, fallback: str) -> str:
    clean = _strip(f"regexp_replace(lower({subject}), '^(re|fw|fwd)\\s*:\\s*', '')")
    return (
        f"CASE WHEN {clean} <> '' THEN substr(md5({clean}), 1, 12) "
        f"ELSE substr({fallback}, 1, 12) END"
    )


# --- terms -------------------------------------------------------------------------------------

SEPARATOR = r"[^\p{L}\p{N}_]+"


def _terms(name: str, source: str, keys: str) -> str:
    """Words and bigrams with their count per mail: ``(keys, term, tf)``."""
    return f"""{name}_words AS (
SELECT {keys}, list_filter(
  regexp_split_to_array(strip_accents(lower(subject || ' ' || body)), '{SEPARATOR}'),
  lambda z: regexp_full_match(z, '[a-z][a-z0-9]+')) AS w FROM {source}),
{name} AS (
SELECT {keys}, term, count(*) AS tf FROM (
 SELECT {keys}, unnest(w) AS term FROM {name}_words
 UNION ALL
 SELECT {keys}, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))
 FROM {name}_words WHERE len(w) > 1) GROUP BY ALL)"""


def _vocabulary(size: int = 5000) -> str:
    return f"""{_terms('terms', 'mail', 'id')},
vocabulary AS (
SELECT (row_number() OVER (ORDER BY term) - 1)::INTEGER AS idx, term, df, cf,
 ln((1 + n)::DOUBLE / (1 + df)) + 1 AS idf
FROM (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, (SELECT count(*) FROM mail) AS n
  FROM terms GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.95::DOUBLE * n
  ORDER BY cf DESC, term LIMIT {size}))"""


VOCABULARY = _vocabulary()


def _weights(terms: str, keys: str) -> str:
    return f"""SELECT {keys}, term,
 round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY {keys})), 6) AS weight
FROM (SELECT {keys}, term, (1 + ln(tf)) * idf AS raw FROM {terms} JOIN vocabulary USING (term))"""


RESULTS = (
    _classified("ruled", "mail"),
    "starting AS (SELECT *, rule_class AS prediction FROM ruled)",
    _downgraded("scored", "starting"),
    f"""results AS (SELECT id, sender, subject, date AS created_at, prediction,
 {_name('prediction')} AS priority, p0, p1, p2, p3,
 CASE prediction WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END AS confidence
FROM scored WHERE trim(subject) <> '' AND trim(body) <> '')""",
)
ALL_RESULTS = (*RESULTS[:3], RESULTS[3].replace(
    "\nFROM scored WHERE trim(subject) <> '' AND trim(body) <> '')", "\nFROM scored)"))


def _centred(c: int, j: int) -> str:
    """A fixed coefficient, less the mean over classes, which predictions do not depend on."""
    values = [((k + 1) * (j + 3)) % 7 - 3 for k in range(4)]
    return f"{(values[c] - sum(values) / 4) / 1000}::DOUBLE"


def _recent(k: int) -> str:
    return _with(
        f"""SELECT id, sender, subject, priority, round(confidence, 6) AS confidence, created_at
FROM results ORDER BY created_at DESC NULLS LAST, id LIMIT {k}""", *ALL_RESULTS)


SIGNALS = f"""phrases AS (
SELECT unnest({_list(P.CRITICAL)}) AS phrase, unnest(range({len(P.CRITICAL)})) AS ord,
  'critical' AS kind, 1.0::DOUBLE AS weight
UNION ALL SELECT unnest({_list(P.HIGH)}), unnest(range({len(P.HIGH)})) + 1000, 'high', 0.5
UNION ALL SELECT unnest({_list(P.LOW)}), unnest(range({len(P.LOW)})) + 2000, 'low', 0.3),
texts AS (SELECT id, body, lower(subject || ' ' || substr(body, 1, 500)) AS t FROM mail),
signals AS (
SELECT id, kind || '_keyword:' || phrase AS signal, weight, ord FROM texts
 JOIN phrases ON contains(t, phrase)
UNION ALL SELECT id, 'has_question', 0.3, 9000 FROM texts WHERE contains(body, '?')
UNION ALL SELECT id, 'exclamation_count', n * 0.2::DOUBLE, 9001 FROM
 (SELECT id, length(body) - length(replace(body, '!', '')) AS n FROM texts) WHERE n > 0)"""

REQUESTS = """rows AS (
SELECT floor(id / 10)::BIGINT::VARCHAR AS request_id, *,
 CASE WHEN subject = '' AND body = '' THEN 'At least one of ''subject'' or ''body'' is required.' END
  AS error,
 (row_number() OVER (PARTITION BY floor(id / 10) ORDER BY id) - 1)::INTEGER AS index
FROM mail_dirty)"""

ORACLE: dict[str, str] = {
    "label_distribution": _with(
        f"""SELECT {_name('priority')} AS priority_label, count(*) AS n,
 round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percent
FROM labelled GROUP BY priority""", _labelled()),
    "assign_priority": _with(
        f"SELECT id, priority, {_name('priority')} AS priority_label FROM labelled", _labelled()),
    "assign_priority_whole_word": _with(
        "SELECT id, priority FROM labelled",
        _labelled(csuite="(" + " OR ".join(map(_whole, P.CSUITE)) + ")")),
    "label_names": _with(
        f"SELECT id, {_name('priority')} AS name, priority AS back FROM labelled", _labelled()),
    "mail_gate": _with(
        "SELECT id, sender, subject FROM mail_dirty WHERE sender <> '' OR subject <> ''",
        MAIL_DIRTY),
    "payload_errors": _with(
        """SELECT id, 'At least one of ''subject'' or ''body'' is required.' AS error
FROM mail_dirty WHERE subject = '' AND body = ''""", MAIL_DIRTY),
    "store_quality": _with(
        """SELECT id, trim(sender) <> '' AND trim(subject) <> '' AND trim(body) <> ''
 AND (priority IS NULL OR priority IN ('critical', 'high', 'normal', 'low')) AS ready
FROM mail_dirty""", MAIL_DIRTY),
    "mail_defaults": _with(
        f"""SELECT h.id, '' AS sender, '' AS recipients, d.subject, '' AS cc, '' AS bcc,
 '' AS folder, (CASE h.id % 3 WHEN 0 THEN 16 WHEN 1 THEN 15 ELSE -1 END)::INTEGER AS hour_of_day,
 (CASE h.id % 3 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE -1 END)::INTEGER AS day_of_week,
 0::INTEGER AS recipient_count, 0::INTEGER AS has_cc, 0::INTEGER AS has_bcc,
 {_starts('re:')} AS subject_has_re, {_starts('fw:', 'fwd:')} AS subject_has_fw
FROM mail_headers h JOIN mail_dirty d USING (id)""", MAIL_DIRTY, MAIL_HEADERS),
    "raw_projection": _with(
        "SELECT message_id, sender, recipients, cc, bcc, subject, body, date, folder FROM mail"),
    "sample_cap": _with("SELECT id, subject FROM mail ORDER BY md5(id || '|42') LIMIT 150"),
    "dedup_first": _with(
        """SELECT id, message_id, seq, priority FROM labelled
QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY seq) = 1""",
        MAIL_DUP, _labelled(source="mail_dup")),
    "dedup_report": _with(
        """SELECT count(*) AS before, count(DISTINCT message_id) AS after,
 count(*) - count(DISTINCT message_id) AS dropped FROM mail_dup""", MAIL_DUP),
    "extract_addresses": _with(
        r"""SELECT id, array_to_string(a, ', ') AS addresses, len(a)::INTEGER AS n_addresses
FROM (SELECT id, regexp_extract_all(to_header, '[\w.\-+]+@[\w.\-]+') AS a FROM mail_headers)""",
        MAIL_HEADERS),
    "parse_dates": _with(
        """SELECT id, CASE id % 3 WHEN 0 THEN TIMESTAMP '2001-05-14 16:39:00'
  WHEN 1 THEN TIMESTAMP '2026-04-23 15:21:00' END AS local_time,
 (CASE id % 3 WHEN 0 THEN 16 WHEN 1 THEN 15 ELSE -1 END)::INTEGER AS hour_of_day,
 (CASE id % 3 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE -1 END)::INTEGER AS day_of_week
FROM mail_headers""", MAIL_HEADERS),
    "parse_dates_free": _with(
        """SELECT id, CASE WHEN k IN (7, 9, 10, 14) THEN TIMESTAMP '2001-05-14 00:00:00' WHEN k = 2 THEN TIMESTAMP '2001-05-14 16:00:00'
 WHEN k = 12 THEN TIMESTAMP '2001-05-14 00:05:00' WHEN k = 15 THEN TIMESTAMP '1999-05-14 08:15:30'
 WHEN k < 17 THEN TIMESTAMP '2001-05-14 16:39:00' END AS local_time FROM (SELECT id, id % 20 AS k FROM mail)"""),
    "sender_domain_counts": _with(
        f"""SELECT domain, store_domain, count(*) AS n, {_bucket('domain')} AS bucket
FROM (SELECT {_domain()} AS domain, string_split(sender, '@')[-1] AS store_domain FROM mail)
GROUP BY domain, store_domain"""),
    "thread_summary": _with(
        f"""SELECT thread_id, count(*) AS mails, sum(subject_has_re)::BIGINT AS replies,
 max(thread_depth) AS max_depth, sum(forward_count)::BIGINT AS forwards,
 min(date) AS first_date, max(date) AS last_date
FROM (SELECT *, {_thread('subject', 'message_id')} AS thread_id FROM features)
GROUP BY thread_id""", FEATURES),
    "conversation_threads": f"""SELECT thread_id, count(*) AS turns,
 count(DISTINCT conv_id) AS conversations
FROM (SELECT conv_id, {_thread("string_split(text, chr(10))[1]", 'conv_id::VARCHAR')} AS thread_id
 FROM conversations) GROUP BY thread_id""",
    "text_clamps": _with(
        """SELECT id, md5(lower(subject) || ' ' || substr(lower(body), 1, 500)) AS label_text,
 md5(lower(subject || ' ' || substr(body, 1, 2000))) AS horizon_text,
 md5(subject || ' ' || substr(body, 1, 256)) AS embedding_text FROM mail"""),
    "csuite_senders": _with(
        f"""SELECT id, {_any('lower(sender)', P.CSUITE)} AS anywhere,
 {" OR ".join(map(_whole, P.CSUITE))} AS whole_word FROM mail"""),
    "phrase_membership": _with(
        f"""SELECT id, {_any('t', P.CRITICAL)} AS critical, {_any('t', P.HIGH)} AS high,
 {_any('t', P.LOW)} AS low, {_any('t', P.DISTANT)} AS distant, {_any('t', P.NEAR)} AS near
FROM (SELECT id, lower(subject || ' ' || substr(body, 1, 500)) AS t FROM mail)"""),
    "feature_meta": _with(f"SELECT id, {', '.join(META)} FROM features", FEATURES),
    "feature_urgency": _with(f"SELECT id, {', '.join(URGENCY)} FROM features", FEATURES),
    "feature_compact": _with(
        "SELECT id, " + ", ".join(c for c in COMPACT).replace(
            "has_deadline", "short_deadline AS has_deadline") + " FROM features", FEATURES),
    "feature_narrow": _with(f"SELECT id, {', '.join(NARROW)} FROM features", FEATURES),
    "feature_names": _with(
        f"""SELECT unnest(range({len(NARROW)}))::INTEGER AS idx, unnest({_list(NARROW)}) AS name
UNION ALL SELECT idx + {len(NARROW)}, term FROM vocabulary""", VOCABULARY),
    "tokenise": _with(
        f"""SELECT id, len(w)::INTEGER AS n_words, md5(array_to_string(w, ' ')) AS words,
 len(c)::INTEGER AS n_compact, md5(array_to_string(c, ' ')) AS compact_words
FROM (SELECT id, w, list_filter(regexp_split_to_array(lower(subject || ' ' || body),
  '{SEPARATOR}'), lambda z: length(z) >= 2) AS c
 FROM terms_words JOIN mail USING (id))""", _terms("terms", "mail", "id")),
    "tfidf_vocabulary": _with(
        "SELECT idx, term, df, cf, round(idf, 6) AS idf FROM vocabulary", VOCABULARY),
    "tfidf_weights": _with(_weights("terms", "id"), VOCABULARY),
    "tfidf_transform": _with(
        _weights("turn_terms", "conv_id, turn"), VOCABULARY,
        "turns AS (SELECT conv_id, turn, '' AS subject, text AS body FROM conversations)",
        _terms("turn_terms", "turns", "conv_id, turn")),
    "embedding_join": _with(
        """SELECT id, 64::INTEGER AS dims,
 round(coalesce(sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))), 0), 4)
  AS length,
 round(coalesce(embedding[1]::DOUBLE, 0), 6) AS first
FROM mail LEFT JOIN embeddings ON vec_id = id"""),
    "rule_score": _with(
        f"""SELECT id, round(s0, 6) AS critical_score, round(s1, 6) AS high_score,
 round(s2, 6) AS normal_score, round(s3, 6) AS low_score, is_far, rule_class, {_round4()}
FROM texts""", _scored("texts", "mail", RULE_TEXT)),
    "rule_classify": _with(f"SELECT id, rule_class, {_round4()} FROM ruled", _classified()),
    "rule_transformer": "WITH " + _fence(_scored("texts", "documents", "text"))
    + f"\nSELECT doc_id, rule_class AS prediction, {_round4()} FROM texts",
    "rule_signals_top10": _with(
        """SELECT id, place::INTEGER AS place, signal, round(weight, 6) AS weight
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, ord) AS place FROM signals)
WHERE place <= 10""", SIGNALS),
    "urgency_bump": _with(f"SELECT id, prediction, {_round4()} FROM bumped", _bumped()),
    "horizon_downgrade": _with(
        f"SELECT id, prediction, {_round4()} FROM lowered",
        STAND_IN, PLAIN_STAND_IN, _downgraded("lowered", "plain")),
    "adjusted_scores": _with(
        f"SELECT id, prediction, {_round4()} FROM adjusted",
        _bumped(), _downgraded("adjusted", "bumped")),
    "score_rules": _with(
        """SELECT id, priority, prediction AS priority_index, round(confidence, 6) AS confidence,
 round(p0, 6) AS score_critical, round(p1, 6) AS score_high, round(p2, 6) AS score_normal,
 round(p3, 6) AS score_low, least(coalesce(n, 0), 10)::INTEGER AS n_signals,
 'rule_based' AS model_used
FROM results LEFT JOIN (SELECT id, count(*) AS n FROM signals GROUP BY id) USING (id)""",
        *ALL_RESULTS, SIGNALS),
    "scored_view": _with(
        """SELECT priority, count(*) AS n, round(min(confidence), 6) AS lowest FROM results
GROUP BY priority""", *ALL_RESULTS),
    "confusion_matrix": _with(
        """SELECT y_true::INTEGER AS y_true,
 sum(n) FILTER (y_pred = 0)::BIGINT AS pred_critical, sum(n) FILTER (y_pred = 1)::BIGINT AS pred_high,
 sum(n) FILTER (y_pred = 2)::BIGINT AS pred_normal, sum(n) FILTER (y_pred = 3)::BIGINT AS pred_low
FROM cells GROUP BY y_true""", *JUDGED),
    "per_class_metrics": _with(
        f"""SELECT class_id::INTEGER AS class_id, {_name('class_id')} AS class,
 round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support
FROM classes""", *JUDGED),
    "classification_report": _with(
        """SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall,
 round(f1, 6) AS f1, support FROM report""", *JUDGED, REPORT),
    "accuracy_macro_f1": _with(
        "SELECT round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1 FROM overall",
        *JUDGED, _overall("overall", "classes")),
    "report_long": _with(
        "SELECT class, metric, round(value, 6) AS value FROM long", *JUDGED, REPORT, LONG_REPORT),
    "report_roundtrip": _with(
        "SELECT 'rule_based' AS model, class, metric, round(value, 6) AS value FROM long",
        *JUDGED, REPORT, LONG_REPORT),
    "roc_points": _with(
        """SELECT class_id::INTEGER AS class_id, score, round(tp::DOUBLE / pos, 6) AS tpr,
 round(fp::DOUBLE / neg, 6) AS fpr FROM points""", _judged(), ROC),
    "roc_points_thin": _with(
        """SELECT class_id::INTEGER AS class_id, score, round(tp::DOUBLE / pos, 6) AS tpr, round(fp::DOUBLE / neg, 6) AS fpr
FROM (SELECT *, lead(tp_step) OVER w AS tp_next, lead(fp_step) OVER w AS fp_next, row_number() OVER w AS place
 FROM points WINDOW w AS (PARTITION BY class_id ORDER BY score DESC))
WHERE place = 1 OR tp_next IS NULL OR tp_next <> tp_step OR fp_next <> fp_step""", _judged(), ROC),
    "roc_auc": _with(
        f"""SELECT class_id::INTEGER AS class_id, {_name('class_id')} AS class,
 round(sum(fp_step * (tp - tp_step / 2.0::DOUBLE)) / (max(pos) * max(neg)), 6) AS auc
FROM points GROUP BY class_id""", _judged(), ROC),
    "class_weights": _with(
        """SELECT priority, count(*) AS n,
 round(sum(count(*)) OVER ()::DOUBLE / (count(*) OVER () * count(*)), 6) AS weight
FROM labelled GROUP BY priority""", _labelled()),
    "stratified_split": _with(
        "SELECT id, priority, is_test FROM placed", _labelled(), _ranks("placed", "labelled", "priority")),
    "stratified_folds": _with(
        "SELECT id, priority, fold FROM placed", _labelled(), _ranks("placed", "labelled", "priority")),
    "training_totals": _with(
        f"""SELECT count(*) AS n_samples, count(*) FILTER (NOT is_test) AS n_train,
 count(*) FILTER (is_test) AS n_test, ({len(NARROW)} + (SELECT count(*) FROM vocabulary))::INTEGER AS n_features,
 42::INTEGER AS random_state, 5::INTEGER AS cv_folds FROM placed""",
        _labelled(), _ranks("placed", "labelled", "priority"), _vocabulary()),
    "candidate_metrics": _with(
        """SELECT model, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1,
 round(cv_accuracy_mean, 6) AS cv_accuracy_mean, round(cv_accuracy_std, 6) AS cv_accuracy_std,
 round(cv_f1_macro_mean, 6) AS cv_f1_macro_mean, round(cv_f1_macro_std, 6) AS cv_f1_macro_std
FROM ranked""", *_candidates()),
    "too_perfect": _with(
        "SELECT model, suspicious, round(selection_key, 6) AS selection_key, place FROM ranked",
        *_candidates()),
    "best_model": _with(
        "SELECT model, round(selection_key, 6) AS selection_key FROM ranked WHERE place = 1",
        *_candidates()),
    "fallback_decision": _with(
        """SELECT model, round(decided_accuracy, 6) AS decided_accuracy,
 round(decided_macro_f1, 6) AS decided_macro_f1, needs_fallback FROM decided""", *_candidates()),
    "fallback_gate": _with(
        """SELECT coalesce(max(needs_fallback), true) AS needs_fallback, 'present' AS report
FROM decided
UNION ALL SELECT coalesce(max(needs_fallback), true), 'missing' FROM decided WHERE false""",
        *_candidates()),
    "published_metrics": _with(
        f"SELECT model, {PUBLISHED}, performance_basis, metrics_caveat FROM published",
        *_candidates()),
    "model_listing": _with(
        f"""SELECT model, {PUBLISHED}, performance_basis, 0.0::DOUBLE AS train_time_s,
 model = (SELECT model FROM decided) AS is_best, count(*) OVER () AS total_models
FROM published""", *_candidates()),
    "active_model": _with(
        f"""SELECT model, {PUBLISHED}, performance_basis, metrics_caveat, needs_fallback,
 0.75::DOUBLE AS accuracy_threshold, 0.65::DOUBLE AS macro_f1_threshold
FROM published JOIN decided USING (model)""", *_candidates()),
    "total_count": "SELECT count(*) AS total FROM documents",
    "priority_counts": _with(
        "SELECT priority, count(*) AS n FROM results GROUP BY priority", *ALL_RESULTS),
    "stored_priority_counts": _with(
        "SELECT priority, count(*) AS n FROM mail_dirty GROUP BY priority", MAIL_DIRTY),
    "priority_counts_zero_filled": _with(
        """SELECT l.priority, count(d.id) AS n
FROM (SELECT unnest(['critical', 'high', 'normal', 'low']) AS priority) l
LEFT JOIN mail_dirty d USING (priority) GROUP BY l.priority""", MAIL_DIRTY),
    "priority_scope": _with(
        "SELECT id, priority FROM mail_dirty WHERE priority IN ('critical', 'high', 'normal', 'low')", MAIL_DIRTY),
    "priority_share": _with(
        """SELECT priority, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS percent
FROM results GROUP BY priority""", *ALL_RESULTS),
    "avg_confidence": _with(
        """SELECT avg_confidence, round(avg_confidence * 100)::INTEGER AS avg_percent
FROM (SELECT coalesce(round(avg(confidence), 3), 0) AS avg_confidence FROM results)""",
        *ALL_RESULTS),
    "recent_10": _recent(10),
    "recent_50": _recent(50),
    "point_lookup": _with("SELECT id, message_id, subject FROM mail WHERE id = 42"),
    "delete_records": _with(
        """SELECT id, message_id FROM mail
WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"""),
    "result_display": _with(
        """SELECT id, round(c * 100, 1) AS percent,
 CASE WHEN c >= 0.85 THEN 'success' WHEN c >= 0.75 THEN 'primary' WHEN c >= 0.65 THEN 'warning'
  ELSE 'danger' END AS band,
 CASE WHEN trim(body) = '' THEN '' WHEN length(body) > 200 THEN substr(body, 1, 197) || '...'
  ELSE body END AS snippet,
 CASE WHEN trim(subject) = '' THEN '' WHEN length(subject) > 20
  THEN substr(subject, 1, 17) || '...' ELSE subject END AS subject_short,
 CASE WHEN id % 9 = 0 THEN 'N/A' WHEN length(body) * 3 < 1000 THEN (length(body) * 3) || ' ms'
  ELSE printf('%.2f s', length(body) * 3 / 1000.0::DOUBLE) END AS duration,
 strftime(coalesce(date, TIMESTAMP '2020-01-01 00:00:00'), '%d %b %Y %H:%M') AS shown_date
FROM (SELECT *, CASE rule_class WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END AS c
 FROM ruled)""", _classified()),
    "scores_json_roundtrip": _with(
        """SELECT id, CASE WHEN id % 7 = 0 THEN 0 ELSE 4 END::INTEGER AS n,
 CASE WHEN id % 7 <> 0 THEN round(p0, 6) END AS critical,
 CASE WHEN id % 7 <> 0 THEN round(p1, 6) END AS high,
 CASE WHEN id % 7 <> 0 THEN round(p2, 6) END AS normal,
 CASE WHEN id % 7 <> 0 THEN round(p3, 6) END AS low FROM ruled""", _classified()),
    "signal_map_top10": _with(
        """SELECT id, place::INTEGER AS place, signal, round(weight, 4) AS value
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(weight) DESC, signal) AS place
 FROM signals) WHERE place <= 10""", SIGNALS),
    "ingest_messages": _with(
        f"""SELECT message_id, sender, recipients, cc, bcc, subject, folder, hour_of_day, day_of_week,
 {_thread('subject', 'message_id')} AS thread_id, priority,
 {_name('priority')} AS priority_label, recipient_count, has_cc, has_bcc, is_reply, is_forward,
 subject_length, word_count
FROM features JOIN (SELECT id, priority FROM labelled) USING (id)""",
        FEATURES, "stripped AS (SELECT * REPLACE (" + _strip("body") + " AS body) FROM mail)",
        _labelled("labelled", "stripped")),
    "ingest_rejects": _with(
        """SELECT '/mail/user' || (id % 5) || '/inbox/' || lpad(id::VARCHAR, 12, '0') AS path,
 CASE WHEN id % 100 = 11 THEN 'unreadable' ELSE 'no sender and no subject' END AS reject_reason
FROM mail_dirty WHERE id % 100 = 11 OR (sender = '' AND subject = '')""", MAIL_DIRTY),
    "csv_roundtrip": _with(
        """SELECT message_id, sender, recipients, cc, bcc, subject, folder, md5(body) AS body
FROM mail"""),
    "batch_requests": _with(
        """SELECT request_id, count(*) AS total, count(*) FILTER (error IS NULL) AS successful,
 count(error) AS failed, CAST(NULL AS VARCHAR) AS request_error FROM rows GROUP BY request_id
UNION ALL SELECT request_id || suffix, 0, 0, 0, reason
 FROM (SELECT DISTINCT request_id FROM rows WHERE request_id::BIGINT % 9 = 0), (VALUES
  ('-none', 'Request must contain an ''emails'' array.'),
  ('-empty', '''emails'' must be a non-empty list.')) AS t(suffix, reason)""", MAIL_DIRTY, REQUESTS),
    "batch_scores": _with(
        f"""SELECT request_id, index, error, CASE WHEN error IS NULL THEN {_name('prediction')} END
 AS priority, CASE WHEN error IS NULL THEN round(CASE prediction WHEN 0 THEN p0 WHEN 1 THEN p1
  WHEN 2 THEN p2 ELSE p3 END, 6) END AS confidence FROM scored
UNION ALL SELECT request_id || suffix, NULL, reason, NULL, NULL
 FROM (SELECT DISTINCT request_id FROM rows WHERE request_id::BIGINT % 9 = 0), (VALUES
  ('-none', 'Request must contain an ''emails'' array.'),
  ('-empty', '''emails'' must be a non-empty list.')) AS t(suffix, reason)""",
        MAIL_DIRTY, REQUESTS, "asked AS (SELECT *, '' AS folder FROM rows)",
        _classified("ruled", "asked"),
        "starting AS (SELECT *, rule_class AS prediction FROM ruled)",
        _downgraded("scored", "starting")),
    "ingest_encoded": _with(
        """SELECT '<' || id || '@x>' AS message_id, 'Grüße ' || id AS subject, md5(CASE id % 5
 WHEN 0 THEN 'Здравствуйте, прошу прислать отчёт до пятницы.'
 WHEN 1 THEN 'お世話になっております。明日の会議の資料をお送りします。'
 WHEN 2 THEN '您好，请在星期五之前把报告发给我，谢谢。'
 WHEN 3 THEN 'déjà vu ' || id ELSE 'café ' || id END) AS body, CAST(NULL AS VARCHAR) AS reject_reason FROM mail"""),
    "store_delete": _with(
        """SELECT id, priority, 'rule_based' AS model_used, created_at FROM results
WHERE id % 10 = 0 OR id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""", *RESULTS),
    "lr_balance": _with(
        "SELECT priority, count(*)::DOUBLE AS expected FROM labelled GROUP BY priority", _labelled()),
    "smote_neighbours": _with(
        f"""SELECT id, place::INTEGER AS place, neighbour FROM (
 SELECT a.id, b.id AS neighbour, row_number() OVER (PARTITION BY a.id ORDER BY round({" + ".join(f"(a.{c}::DOUBLE - b.{c}) * (a.{c}::DOUBLE - b.{c})" for c in NARROW)}, 6), b.id) AS place
 FROM near a JOIN near b ON a.priority = b.priority AND a.id <> b.id) WHERE place <= 5""",
        FEATURES, _labelled(), """near AS (SELECT f.*, l.priority FROM features f JOIN (SELECT id, priority FROM labelled) l USING (id)
 WHERE l.priority IN (SELECT priority FROM labelled GROUP BY priority HAVING count(*) < (SELECT max(n) FROM (SELECT count(*) AS n FROM labelled GROUP BY priority))))"""),
    "smote_rows": _with(
        """SELECT priority, (most - n)::BIGINT AS made, 0::BIGINT AS astray, true AS numbered
FROM (SELECT priority, count(*) AS n, max(count(*)) OVER () AS most FROM labelled GROUP BY priority) WHERE n < most""", _labelled()),
    "unreadable_distribution": _with(
        "SELECT vec_id AS id, 2::INTEGER AS prediction, 0.05::DOUBLE AS p0, 0.15::DOUBLE AS p1, 0.7::DOUBLE AS p2, 0.1::DOUBLE AS p3 FROM embeddings"),
    "report_nested": _with(
        "SELECT 'rule_based' AS model, class, metric, round(value, 6) AS value FROM long", *JUDGED, REPORT, LONG_REPORT),
    "evaluation_document": _with(
        """SELECT r.model, r.place, m.n_test::BIGINT AS n_test, m.matrix, round(r.accuracy, 6) AS accuracy, round(r.macro_f1, 6) AS macro_f1,
 0.75::DOUBLE AS accuracy_threshold, 0.65::DOUBLE AS macro_f1_threshold, d.needs_fallback
FROM ranked r JOIN (SELECT model, sum(n) AS n_test, '[' || string_agg(cells, ',' ORDER BY y_true) || ']' AS matrix
 FROM (SELECT model, y_true, sum(n) AS n, '[' || string_agg(n::VARCHAR, ',' ORDER BY y_pred) || ']' AS cells
  FROM (SELECT g.model, g.t AS y_true, g.p AS y_pred, count(x.id)::BIGINT AS n
   FROM (SELECT model, t, p FROM (SELECT DISTINCT model FROM tested), range(4) a(t), range(4) b(p)) g
   LEFT JOIN tested x ON x.model = g.model AND x.y_true = g.t AND x.y_pred = g.p GROUP BY ALL) GROUP BY model, y_true) GROUP BY model) m USING (model)
LEFT JOIN decided d USING (model)""", *_candidates()),
    "row_attribution_fixed": _with(
        "SELECT id, place::INTEGER AS place, name, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, idx) AS place FROM ("
        + " UNION ALL ".join(
            f"SELECT id, {j} AS idx, '{name}' AS name, abs({name}::DOUBLE * CASE c "
            + " ".join(f"WHEN {c} THEN {_centred(c, j)}" for c in range(4)) + " END) AS weight FROM chosen" for j, name in enumerate(NARROW))
        + ")) WHERE place <= 10 AND round(weight, 6) > 0", FEATURES,
        "chosen AS (SELECT *, CASE greatest(z0, z1, z2, z3) WHEN z0 THEN 0 WHEN z1 THEN 1 WHEN z2 THEN 2 ELSE 3 END AS c FROM (SELECT *, "
        + ", ".join(
            f"{c / 10}::DOUBLE + " + " + ".join(f"{((c + 1) * (j + 3)) % 7 - 3} * {name}::DOUBLE / 1000" for j, name in enumerate(NARROW)) + f" AS z{c}"
            for c in range(4))
        + " FROM features))"),
    "score_fixed_model": _with(
        "SELECT id, (CASE greatest(e0, e1, e2, e3) WHEN e0 THEN 0 WHEN e1 THEN 1 WHEN e2 THEN 2 ELSE 3 END)::INTEGER AS prediction, "
        + ", ".join(f"round(e{c} / (e0 + e1 + e2 + e3), 5) AS p{c}" for c in range(4))
        + " FROM (SELECT id, " + ", ".join(f"exp(z{c} - greatest(z0, z1, z2, z3)) AS e{c}" for c in range(4)) + " FROM (SELECT id, "
        + ", ".join(
            f"{c / 10}::DOUBLE + " + " + ".join(f"{((c + 1) * (j + 3)) % 7 - 3} * {name}::DOUBLE / 1000" for j, name in enumerate(NARROW)) + f" AS z{c}"
            for c in range(4))
        + " FROM features))", FEATURES),
    "store_append": _with(
        "SELECT id, priority, 'rule_based' AS model_used, created_at FROM results", *RESULTS),
    "stream_score": _with(
        """SELECT id, priority, round(confidence, 6) AS confidence, 'rule_based' AS model_used
FROM results""", *RESULTS),
    "stream_counts": _with(
        "SELECT priority, count(*) AS n FROM results GROUP BY priority", *ALL_RESULTS),
    "smote_counts": _with(
        """SELECT priority, count(*) AS before, max(count(*)) OVER () AS after FROM labelled
GROUP BY priority""", _labelled()),
    "feature_matrix": _with(
        f"""SELECT id, {len(NARROW)} + 64 + (SELECT count(*) FROM vocabulary)::INTEGER AS width,
 ({" + ".join(f"({c} <> 0)::INTEGER" for c in NARROW)} + coalesce(n, 0)
  + coalesce(len(list_filter(embedding, lambda v: v <> 0)), 0))::INTEGER AS filled
FROM features LEFT JOIN (SELECT id, count(*) AS n FROM terms JOIN vocabulary USING (term) GROUP BY id)
 USING (id) LEFT JOIN (SELECT vec_id AS id, embedding FROM embeddings) USING (id)""",
        FEATURES, _vocabulary()),
    "attribution_fixed": _with(
        " UNION ALL ".join(
            f"""SELECT '{name}' AS name, round({sum(abs(((c + 1) * (j + 3)) % 7 - 3.0) for c in range(4)) / 4}::DOUBLE
 * (SELECT avg(abs({name}::DOUBLE - m)) FROM features, (SELECT avg({name}::DOUBLE) AS m FROM features)) + 3.3e-6::DOUBLE, 4) AS weight"""
            for j, name in enumerate(NARROW)), FEATURES),
    "train_choose_score": _with(
        """SELECT count(*) AS n_mails, count(*) AS n_confident, count(*) AS n_sum_one, count(*) AS n_own_share,
 1::BIGINT AS n_models FROM mail"""),
    "stream_dedup": _with(
        """SELECT id, message_id, subject, CASE WHEN id % 10 = 0 THEN 'a' ELSE 'b' END || id AS path
FROM (SELECT *, CASE WHEN id % 23 <> 0 THEN epoch_ms(date) END AS moment FROM mail)
WHERE moment + 86400000 < (SELECT max(epoch_ms(date)) FROM mail WHERE id % 23 <> 0) - 86400000"""),
}
ORACLE["ingest_files"] = ORACLE["ingest_messages"]  # the same mail, from files
