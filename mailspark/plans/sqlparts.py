"""DuckDB SQL fragments for the oracle side of every registered query.

They restate the engine's semantics in plain SQL on the same parquet tables,
written independently of the Spark code so the two can check each other.
"""

from __future__ import annotations


def x2(s: str) -> str:
    return rf"regexp_replace({s}, '[^\x20-\x7E\n\r\t]', '', 'g')"


def x4(s: str) -> str:
    return rf"regexp_replace({s}, '\A[\p{{Z}}\x09-\x0D\x{{85}}]+|[\p{{Z}}\x09-\x0D\x{{85}}]+\z', '', 'g')"


def trim_ws(s: str) -> str:
    return rf"regexp_replace({s}, '\A[\t\p{{Zs}}]+|[\t\p{{Zs}}]+\z', '', 'g')"


def f4(s: str) -> str:
    return rf"coalesce(regexp_matches({s}, '\A[\x09-\x0D\x20-\x7E]*\z'), true)"


def f5(s: str) -> str:
    return rf"coalesce(regexp_matches({s}, '\A[\t\n\r\x20-\x7E]*\z'), true)"


def x1(s: str) -> str:
    rtf = rf"regexp_replace({s}, '(?is)content-type: application/rtf.*?(\n--|\z)', '\1', 'g')"
    multi = rf"regexp_replace({rtf}, '(?is)content-type: multipart/mixed.*\z', '')"
    return rf"regexp_replace({multi}, '(?is)content-disposition: attachment.*\z', '')"


def pieces(s: str) -> str:
    return f"string_split_regex(coalesce({s}, ''), '[.!?]')"


def first_sentence_thread_form(s: str) -> str:
    return x4(f"list_filter({pieces(s)}, lambda p: length(p) > 8)[1]")


def first_sentence(s: str) -> str:
    return f"coalesce(list_filter(list_transform({pieces(s)}, lambda p: {x4('p')}), lambda p: length(p) > 8)[1], '')"


def last_sentence(s: str) -> str:
    return f"coalesce(list_filter(list_transform({pieces(s)}, lambda p: {x4('p')}), lambda p: length(p) > 8)[-1], '')"


def contains_ci(s: str, keyword_lower: str) -> str:
    return f"coalesce(contains(lower({s}), '{keyword_lower}'), false)"


def sanitize(s: str) -> str:
    return rf"""regexp_replace({x2(s)}, '[/\\:?%*|"<>'']', '_', 'g')"""


def thread_name(subject: str, num: str, prefix: str) -> str:
    fallback = f"printf('thread%04d', {num})"
    base = f"CASE WHEN length(coalesce({subject}, '')) > 0 THEN {subject} ELSE {fallback} END"
    clean = f"substring({sanitize(base)}, 1, 48)"
    return f"'{prefix}' || CASE WHEN length({clean}) = 0 THEN {fallback} ELSE {clean} END || '.txt'"


def message_text(f: str = "from_addr", s: str = "subject", d: str = "date", b: str = "body") -> str:
    nl = "chr(10)"

    def field(c: str) -> str:
        return x2("coalesce(" + c + ", '')")

    return (
        f"'From: ' || {field(f)} || {nl} || 'Subject: ' || {field(s)} || {nl}"
        f" || 'Date: ' || {field(d)} || {nl} || {nl} || {field(b)}"
    )


# The email view (same mapping as mailspark.sources.views.email_columns).
EMAIL_VIEW = """
SELECT row_number() OVER (ORDER BY conv_id, turn) AS msg_seq, conv_id, turn,
       role || '@example.com' AS from_addr,
       CASE conv_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Topic ' || (conv_id % 10)
            WHEN 2 THEN 'TOPIC ' || ((conv_id - 1) % 10)
            WHEN 3 THEN 'Plan: a/b? ' || (conv_id % 4) ELSE 'Plan_ a_b_ ' || (conv_id % 4) END AS subject,
       CASE WHEN turn % 7 = 6 THEN NULL ELSE '2024-01-' || lpad(CAST(turn % 28 + 1 AS VARCHAR), 2, '0') END AS date,
       text AS body
FROM conversations
"""

# Messages with their thread key and O1 rank inside and across threads.
EMAIL_RANKED = f"""
emails AS ({EMAIL_VIEW}),
keyed AS (SELECT *, coalesce(lower(subject), '') AS thread_key FROM emails),
ranked AS (
  SELECT *,
         row_number() OVER (PARTITION BY thread_key ORDER BY date ASC NULLS FIRST, msg_seq ASC) AS position,
         row_number() OVER (PARTITION BY thread_key ORDER BY date DESC NULLS LAST, msg_seq DESC) AS rev_position,
         count(*) OVER (PARTITION BY thread_key) AS n_messages,
         min(msg_seq) OVER (PARTITION BY thread_key) AS first_seq
  FROM keyed)
"""

# One row per thread with every A5-A8 value and its W3 number.
THREADS = f"""
{EMAIL_RANKED},
sent AS (
  SELECT *, {first_sentence_thread_form('body')} AS fs, {last_sentence('body')} AS ls FROM ranked),
thread_rows AS (
  SELECT thread_key,
         any_value(n_messages) AS n_messages,
         any_value(first_seq) AS first_seq,
         coalesce(max(CASE WHEN position = 1 THEN subject END), '') AS subject,
         max(CASE WHEN position = 1 THEN from_addr END) AS from_first,
         max(CASE WHEN position = 1 THEN date END) AS date_first,
         max(CASE WHEN rev_position = 1 THEN from_addr END) AS from_last,
         max(CASE WHEN rev_position = 1 THEN date END) AS date_last,
         coalesce(arg_min(fs, position) FILTER (WHERE fs IS NOT NULL), '') AS first_sentence,
         coalesce(arg_max(ls, position) FILTER (WHERE ls <> ''), '') AS last_sentence
  FROM sent GROUP BY thread_key),
threads AS (SELECT *, row_number() OVER (ORDER BY first_seq) AS thread_num FROM thread_rows)
"""
