"""Registered mail queries: text functions, searches, threads, numbering,
rendering and file names, each with its DuckDB oracle SQL (same column names).

Inputs are the driver tables: ``documents`` for text functions, the email view
over ``conversations`` for everything mail-shaped, ``pages.url`` for names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filenames as N
from ..functions import text as X
from ..operators import render, search, threads
from ..operators.numbering import add_sequence_by_key
from ..sources.views import email_view, read_table
from . import sqlparts as Q



# --------------------------------------------------------------- text functions
def _clear_input() -> F.Column:
    d = F.col("doc_id") % 3
    ascii_text = X.strip_non_ascii("text")
    return (
        F.when(d == 0, F.col("text"))
        .when(d == 1, ascii_text)
        .otherwise(F.concat(ascii_text, F.when(F.col("doc_id") % 2 == 0, F.lit("\x0b")).otherwise(F.lit("\x0c"))))
    )


def clear_text_flags(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", _clear_input().alias("t"))
    return docs.select("doc_id", X.is_clear_text("t").alias("clear_lenient"), X.is_clear_text_strict("t").alias("clear_strict"))


_CLEAR_INPUT_SQL = f"""CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN {Q.x2('text')}
    ELSE {Q.x2('text')} || CASE WHEN doc_id % 2 = 0 THEN chr(11) ELSE chr(12) END END"""

CLEAR_TEXT_FLAGS_SQL = f"""
SELECT doc_id, {Q.f4('t')} AS clear_lenient, {Q.f5('t')} AS clear_strict
FROM (SELECT doc_id, {_CLEAR_INPUT_SQL} AS t FROM documents)
"""


def strip_non_ascii(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    return docs.select("doc_id", X.strip_non_ascii("text").alias("stripped"))


STRIP_NON_ASCII_SQL = f"SELECT doc_id, {Q.x2('text')} AS stripped FROM documents"

# Padding around the text: LF TAB space ... NBSP, ideographic space, CR, FF, NEL.
_PAD_LEFT = "\n\t  "
_PAD_RIGHT = " 　\r\x0c\u0085"


def trim_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    padded = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(_PAD_LEFT), "text", F.lit(_PAD_RIGHT))).otherwise(F.col("text"))
    return docs.select("doc_id", X.trim_ws_nl(padded).alias("trimmed"))


TRIM_TEXT_SQL = f"""
SELECT doc_id, {Q.x4('p')} AS trimmed FROM (
  SELECT doc_id, CASE WHEN doc_id % 2 = 0
      THEN chr(10) || chr(9) || ' ' || chr(160) || text || ' ' || chr(12288) || chr(13) || chr(12) || chr(133)
      ELSE text END AS p
  FROM documents)
"""


def _attachment_input() -> F.Column:
    d = F.col("doc_id") % 5
    t = F.col("text")
    return (
        F.when(d == 0, t)
        .when(d == 1, F.concat(t, F.lit("\nContent-Type: application/rtf\n{\\rtf1 x}\n--b1\nAfter part.")))
        .when(d == 2, F.concat(F.lit("Intro "), t, F.lit("\ncontent-type: MULTIPART/mixed; boundary=x\n"), t))
        .when(d == 3, F.concat(t, F.lit("\nContent-Disposition: attachment; filename=a.txt\nDATA")))
        .otherwise(
            F.concat(
                F.lit("A.\nContent-Type: application/rtf\n{\\rtf1}\n--x\nmiddle\nCONTENT-TYPE: APPLICATION/RTF\n"), t
            )
        )
    )


def remove_attachments(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", _attachment_input().alias("t"))
    return docs.select("doc_id", X.remove_attachments("t").alias("cleaned"))


_ATTACH_INPUT_SQL = r"""CASE doc_id % 5 WHEN 0 THEN text
  WHEN 1 THEN text || chr(10) || 'Content-Type: application/rtf' || chr(10) || '{\rtf1 x}' || chr(10) || '--b1' || chr(10) || 'After part.'
  WHEN 2 THEN 'Intro ' || text || chr(10) || 'content-type: MULTIPART/mixed; boundary=x' || chr(10) || text
  WHEN 3 THEN text || chr(10) || 'Content-Disposition: attachment; filename=a.txt' || chr(10) || 'DATA'
  ELSE 'A.' || chr(10) || 'Content-Type: application/rtf' || chr(10) || '{\rtf1}' || chr(10) || '--x' || chr(10)
       || 'middle' || chr(10) || 'CONTENT-TYPE: APPLICATION/RTF' || chr(10) || text END"""

REMOVE_ATTACHMENTS_SQL = f"SELECT doc_id, {Q.x1('t')} AS cleaned FROM (SELECT doc_id, {_ATTACH_INPUT_SQL} AS t FROM documents)"


def first_last_sentence(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    return docs.select(
        "doc_id",
        X.first_sentence("text").alias("first_sentence"),
        X.last_sentence("text").alias("last_sentence"),
        X.first_sentence_thread_form("text").alias("first_piece"),
    )


FIRST_LAST_SENTENCE_SQL = f"""
SELECT doc_id, {Q.first_sentence('text')} AS first_sentence, {Q.last_sentence('text')} AS last_sentence,
       {Q.first_sentence_thread_form('text')} AS first_piece
FROM documents
"""


# --------------------------------------------------------------------- searches
def search_sender_count(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_count(email_view(spark, sf, numbered=False), "from", "  Assistant\t", "n_emails")


SEARCH_SENDER_COUNT_SQL = f"WITH emails AS ({Q.EMAIL_VIEW}) SELECT count(*) FILTER (WHERE {Q.contains_ci('from_addr', 'assistant')}) AS n_emails FROM emails"


def search_subject_count(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_count(email_view(spark, sf, numbered=False), "subject", " topic 1 ", "n_emails")


SEARCH_SUBJECT_COUNT_SQL = f"WITH emails AS ({Q.EMAIL_VIEW}) SELECT count(*) FILTER (WHERE {Q.contains_ci('subject', 'topic 1')}) AS n_emails FROM emails"


def search_body_count(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_count(email_view(spark, sf, numbered=False), "count", "The", "n_emails")


SEARCH_BODY_COUNT_SQL = f"WITH emails AS ({Q.EMAIL_VIEW}) SELECT count(*) FILTER (WHERE {Q.contains_ci('body', 'the')}) AS n_emails FROM emails"

_MULTI = [
    ("n_from_user", "from", "USER"),
    ("n_subject_plan", "subject", "plan"),
    ("n_subject_slash", "subject", "a/b?"),
    ("n_body_la", "count", " la "),
    ("n_body_empty", "count", "   "),
    ("n_date_jan", "date", "2024-01-0"),
]


def multi_keyword_counts(spark: SparkSession, sf: str) -> DataFrame:
    return search.multi_counts(email_view(spark, sf, numbered=False), _MULTI)


MULTI_KEYWORD_COUNTS_SQL = f"""
WITH emails AS ({Q.EMAIL_VIEW})
SELECT count(*) FILTER (WHERE {Q.contains_ci('from_addr', 'user')}) AS n_from_user,
       count(*) FILTER (WHERE {Q.contains_ci('subject', 'plan')}) AS n_subject_plan,
       count(*) FILTER (WHERE {Q.contains_ci('subject', 'a/b?')}) AS n_subject_slash,
       count(*) FILTER (WHERE {Q.contains_ci('body', 'la')}) AS n_body_la,
       CAST(0 AS BIGINT) AS n_body_empty,
       count(*) FILTER (WHERE {Q.contains_ci('date', '2024-01-0')}) AS n_date_jan
FROM emails
"""


def union_all_load(spark: SparkSession, sf: str) -> DataFrame:
    """The same archive loaded twice -> duplicates kept, numbering continues."""
    e = email_view(spark, sf)
    both = e.withColumn("load_no", F.lit(1)).unionByName(e.withColumn("load_no", F.lit(2)))
    numbered = add_sequence_by_key(both, ["load_no", "msg_seq"], "session_seq")
    return numbered.groupBy("load_no").agg(
        F.count(F.lit(1)).alias("n_emails"),
        F.min("session_seq").alias("min_seq"),
        F.max("session_seq").alias("max_seq"),
        F.count_distinct("msg_seq").alias("n_distinct_msg"),
    )


UNION_ALL_LOAD_SQL = f"""
WITH emails AS ({Q.EMAIL_VIEW}),
both_loads AS (SELECT *, 1 AS load_no FROM emails UNION ALL SELECT *, 2 AS load_no FROM emails),
numbered AS (SELECT *, row_number() OVER (ORDER BY load_no, msg_seq) AS session_seq FROM both_loads)
SELECT load_no, count(*) AS n_emails, min(session_seq) AS min_seq, max(session_seq) AS max_seq,
       count(DISTINCT msg_seq) AS n_distinct_msg
FROM numbered GROUP BY load_no
"""


# ---------------------------------------------------------------------- threads
def thread_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return threads.thread_sizes(email_view(spark, sf, numbered=False))


THREAD_SIZES_SQL = f"""
WITH emails AS ({Q.EMAIL_VIEW})
SELECT coalesce(lower(subject), '') AS thread_key, count(*) AS n_messages FROM emails GROUP BY 1
"""


def thread_first_last(spark: SparkSession, sf: str) -> DataFrame:
    t = threads.thread_aggregates(email_view(spark, sf))
    return t.select("thread_key", "subject", "from_first", "date_first", "from_last", "date_last")


THREAD_FIRST_LAST_SQL = f"WITH {Q.THREADS} SELECT thread_key, subject, from_first, date_first, from_last, date_last FROM threads"


def thread_sentences(spark: SparkSession, sf: str) -> DataFrame:
    t = threads.thread_aggregates(email_view(spark, sf))
    return t.select("thread_key", "first_sentence", "last_sentence")


THREAD_SENTENCES_SQL = f"WITH {Q.THREADS} SELECT thread_key, first_sentence, last_sentence FROM threads"


def thread_count(spark: SparkSession, sf: str) -> DataFrame:
    return threads.thread_count(email_view(spark, sf, numbered=False))


THREAD_COUNT_SQL = f"WITH emails AS ({Q.EMAIL_VIEW}) SELECT count(DISTINCT coalesce(lower(subject), '')) AS n_threads FROM emails"


# -------------------------------------------------------------------- numbering
def message_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return email_view(spark, sf).select("msg_seq", "conv_id", "turn")


MESSAGE_NUMBERS_SQL = f"WITH emails AS ({Q.EMAIL_VIEW}) SELECT msg_seq, conv_id, turn FROM emails"


def thread_positions(spark: SparkSession, sf: str) -> DataFrame:
    return threads.thread_positions(email_view(spark, sf)).select("msg_seq", "thread_key", "position")


THREAD_POSITIONS_SQL = f"WITH {Q.EMAIL_RANKED} SELECT msg_seq, thread_key, position FROM ranked"


def thread_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return threads.threads(email_view(spark, sf)).select("thread_key", "thread_num", "first_seq", "n_messages")


THREAD_NUMBERS_SQL = f"WITH {Q.THREADS} SELECT thread_key, thread_num, first_seq, n_messages FROM threads"


def _rfc_dates(emails: DataFrame) -> DataFrame:
    day = ((F.col("turn") * 5) % 28 + 1).cast("string")
    d = F.when(F.col("date").isNull(), F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("Mon, "), day, F.lit(" Jan 2024 10:00:00 +0000 (UTC)"))
    )
    return emails.withColumn("date", d)


def thread_chronological(spark: SparkSession, sf: str) -> DataFrame:
    """Position by parsed date (string order would put '11 Jan' before '6 Jan')."""
    e = _rfc_dates(email_view(spark, sf))
    pos = threads.thread_positions(e, threads.CHRONOLOGICAL_ORDER)
    return pos.select("msg_seq", "thread_key", "date", F.col("position").alias("position_chrono"))


THREAD_CHRONOLOGICAL_SQL = f"""
WITH emails AS ({Q.EMAIL_VIEW}),
d AS (SELECT msg_seq, coalesce(lower(subject), '') AS thread_key,
             CASE WHEN date IS NULL THEN NULL ELSE 'Mon, ' || CAST((turn * 5) % 28 + 1 AS VARCHAR) || ' Jan 2024 10:00:00 +0000 (UTC)' END AS date
      FROM emails),
p AS (SELECT *, strptime(regexp_replace(date, ' \\(UTC\\)$', ''), '%a, %d %b %Y %H:%M:%S %z') AS ts FROM d)
SELECT msg_seq, thread_key, date,
       row_number() OVER (PARTITION BY thread_key ORDER BY ts ASC NULLS FIRST, msg_seq) AS position_chrono
FROM p
"""


# ---------------------------------------------------------- totals, unique names
def session_total(spark: SparkSession, sf: str) -> DataFrame:
    """A2: messages in the session."""
    return search.total(email_view(spark, sf, numbered=False))


SESSION_TOTAL_SQL = "SELECT count(*) AS n_emails FROM conversations"


def unique_names(spark: SparkSession, sf: str) -> DataFrame:
    """N5, opt-in: names that differ for all summaries; the latest thread keeps the plain name."""
    t = threads.threads(email_view(spark, sf))
    named = t.select("thread_num", N.summary_filename("subject", "thread_num").alias("file_name"))
    return render.unique_filenames(named)


UNIQUE_NAMES_SQL = f"""WITH {Q.THREADS},
named AS (SELECT thread_num, {Q.thread_name('subject', 'thread_num', 'summary ')} AS file_name FROM threads),
r AS (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY thread_num DESC) AS k FROM named)
SELECT thread_num, CASE WHEN k = 1 THEN file_name ELSE regexp_replace(file_name, '\\.txt$', '') || ' (' || (k - 1) || ').txt' END AS file_name FROM r"""


# ---------------------------------------------------------------- sentence pieces
def sentence_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces between '.', '!' and '?'."""
    pieces = X.sentences("text")
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", F.size(pieces).cast("long").alias("n_pieces"), F.element_at(pieces, -1).alias("last_piece"))


SENTENCE_PIECES_SQL = f"SELECT doc_id, len({Q.pieces('text')}) AS n_pieces, ({Q.pieces('text')})[-1] AS last_piece FROM documents"


# -------------------------------------------------------------- search extras
def search_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Messages whose Date lies in a range."""
    e = email_view(spark, sf, numbered=False)
    return e.filter(search.date_between("2024-01-03", "2024-01-09")).select("conv_id", "turn", "date")


SEARCH_DATES_SQL = f"""WITH emails AS ({Q.EMAIL_VIEW})
SELECT conv_id, turn, date FROM emails WHERE try_strptime(date, '%Y-%m-%d') BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-09'"""


def search_regex(spark: SparkSession, sf: str) -> DataFrame:
    """Regular expression on one field."""
    e = email_view(spark, sf, numbered=False)
    return search.regex_search(e, "subject", "(?i)^(topic|plan).*[02468]$").select("conv_id", "turn", "subject")


SEARCH_REGEX_SQL = f"""WITH emails AS ({Q.EMAIL_VIEW})
SELECT conv_id, turn, subject FROM emails WHERE regexp_matches(subject, '^(topic|plan).*[02468]$', 'i')"""


def search_and_or(spark: SparkSession, sf: str) -> DataFrame:
    """E5: AND / OR of field searches."""
    e = email_view(spark, sf, numbered=False)
    either = search.any_of(search.match("subject", "topic 1"), search.match("subject", "plan"))
    return e.filter(search.all_of(either, search.match("from", "user"), search.match("count", "th"))).select("conv_id", "turn", "from_addr")


SEARCH_AND_OR_SQL = f"""WITH emails AS ({Q.EMAIL_VIEW})
SELECT conv_id, turn, from_addr FROM emails
WHERE ({Q.contains_ci('subject', 'topic 1')} OR {Q.contains_ci('subject', 'plan')}) AND {Q.contains_ci('from_addr', 'user')} AND {Q.contains_ci('body', 'th')}"""


# -------------------------------------------------------------------- rendering
def render_messages(spark: SparkSession, sf: str) -> DataFrame:
    return render.render_messages(email_view(spark, sf))


RENDER_MESSAGES_SQL = f"""
WITH emails AS ({Q.EMAIL_VIEW})
SELECT msg_seq, printf('message%04d.txt', msg_seq) AS file_name, {Q.message_text()} AS content FROM emails
"""


def render_threads(spark: SparkSession, sf: str) -> DataFrame:
    return render.render_thread_pieces(email_view(spark, sf))


RENDER_THREADS_SQL = f"""
WITH {Q.THREADS}
SELECT {Q.thread_name('t.subject', 't.thread_num', 'export ')} AS file_name, t.thread_num, r.position, r.msg_seq,
       '----- Email #' || r.position || ' -----' || chr(10)
       || {Q.message_text('r.from_addr', 'r.subject', 'r.date', 'r.body')} || chr(10) || chr(10) AS piece
FROM ranked r JOIN threads t USING (thread_key)
"""


def _summary_sql() -> str:
    def field(c: str) -> str:
        return Q.x2("coalesce(" + c + ", 'unknown')")

    began = f"CASE WHEN length(first_sentence) > 0 THEN 'Thread began: ' || {Q.x2('first_sentence')} || chr(10) ELSE '' END"
    ended = (
        f"CASE WHEN length(last_sentence) > 0 AND first_sentence <> last_sentence "
        f"THEN 'Thread ended: ' || {Q.x2('last_sentence')} || chr(10) ELSE '' END"
    )
    return (
        f"'Subject: ' || {Q.x2('subject')} || chr(10) || 'Thread length: ' || n_messages || ' message(s)' || chr(10)"
        f" || 'From: ' || {field('from_first')} || ' (' || {field('date_first')} || ')' || chr(10)"
        f" || 'To:   ' || {field('from_last')} || ' (' || {field('date_last')} || ')' || chr(10)"
        f" || {began} || {ended}"
    )


def thread_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return render.render_summaries(email_view(spark, sf))


THREAD_SUMMARIES_SQL = f"""
WITH {Q.THREADS}
SELECT thread_num, {Q.thread_name('subject', 'thread_num', 'summary ')} AS file_name, {_summary_sql()} AS content
FROM threads
"""


# ------------------------------------------------------------------- file names
def message_filenames(spark: SparkSession, sf: str) -> DataFrame:
    e = email_view(spark, sf)
    return e.select(
        "msg_seq",
        N.message_filename("msg_seq").alias("file_name"),
        N.message_filename(F.col("msg_seq") * 397).alias("wide_name"),
    )


MESSAGE_FILENAMES_SQL = f"""
WITH emails AS ({Q.EMAIL_VIEW})
SELECT msg_seq, printf('message%04d.txt', msg_seq) AS file_name, printf('message%04d.txt', msg_seq * 397) AS wide_name
FROM emails
"""


def export_filenames(spark: SparkSession, sf: str) -> DataFrame:
    t = threads.threads(email_view(spark, sf))
    return t.select("thread_num", "thread_key", N.export_filename("subject", "thread_num").alias("file_name"))


EXPORT_FILENAMES_SQL = f"WITH {Q.THREADS} SELECT thread_num, thread_key, {Q.thread_name('subject', 'thread_num', 'export ')} AS file_name FROM threads"


def summary_filenames(spark: SparkSession, sf: str) -> DataFrame:
    t = threads.threads(email_view(spark, sf))
    return t.select("thread_num", "thread_key", N.summary_filename("subject", "thread_num").alias("file_name"))


SUMMARY_FILENAMES_SQL = f"WITH {Q.THREADS} SELECT thread_num, thread_key, {Q.thread_name('subject', 'thread_num', 'summary ')} AS file_name FROM threads"


def filename_collisions(spark: SparkSession, sf: str) -> DataFrame:
    named = render.render_summaries(email_view(spark, sf))
    return render.filename_collisions(named)


FILENAME_COLLISIONS_SQL = f"""
WITH {Q.THREADS},
named AS (SELECT thread_num, {Q.thread_name('subject', 'thread_num', 'summary ')} AS file_name FROM threads)
SELECT file_name, count(*) AS n_documents, max(thread_num) AS winner, count(*) - 1 AS n_replaced
FROM named GROUP BY file_name
"""


def sanitize_names(spark: SparkSession, sf: str) -> DataFrame:
    """N4 and N2 on web page URLs (every forbidden character occurs)."""
    pages = read_table(spark, sf, "pages")
    subj = F.concat(F.col("url"), F.lit(" \"q\" <x> 'y' | * % \\ é"))
    return pages.select(
        "page_id",
        N.sanitize_for_filename(subj).alias("sanitized"),
        N.export_filename(subj, "page_id").alias("export_name"),
    )


SANITIZE_NAMES_SQL = f"""
SELECT page_id, {Q.sanitize('s')} AS sanitized, {Q.thread_name('s', 'page_id', 'export ')} AS export_name
FROM (SELECT page_id, url || ' "q" <x> ''y'' | * % \\ é' AS s FROM pages)
"""


def email_description(spark: SparkSession, sf: str) -> DataFrame:
    e = email_view(spark, sf)
    return e.select("msg_seq", X.describe_email().alias("description"))


EMAIL_DESCRIPTION_SQL = f"""
WITH emails AS ({Q.EMAIL_VIEW})
SELECT msg_seq, '<Email from:' || coalesce(from_addr, '(none)') || ' subject:' || coalesce(subject, '(none)')
       || ' date:' || coalesce(date, '(none)') || '>' AS description
FROM emails
"""


QUERIES = {
    "clear_text_flags": clear_text_flags,
    "strip_non_ascii": strip_non_ascii,
    "trim_text": trim_text,
    "remove_attachments": remove_attachments,
    "first_last_sentence": first_last_sentence,
    "search_sender_count": search_sender_count,
    "search_subject_count": search_subject_count,
    "search_body_count": search_body_count,
    "multi_keyword_counts": multi_keyword_counts,
    "union_all_load": union_all_load,
    "thread_sizes": thread_sizes,
    "thread_first_last": thread_first_last,
    "thread_sentences": thread_sentences,
    "thread_count": thread_count,
    "message_numbers": message_numbers,
    "thread_positions": thread_positions,
    "thread_numbers": thread_numbers,
    "thread_chronological": thread_chronological,
    "session_total": session_total,
    "unique_names": unique_names,
    "sentence_pieces": sentence_pieces,
    "search_dates": search_dates,
    "search_regex": search_regex,
    "search_and_or": search_and_or,
    "render_messages": render_messages,
    "render_threads": render_threads,
    "thread_summaries": thread_summaries,
    "message_filenames": message_filenames,
    "export_filenames": export_filenames,
    "summary_filenames": summary_filenames,
    "filename_collisions": filename_collisions,
    "sanitize_names": sanitize_names,
    "email_description": email_description,
}

ORACLE_SQL = {
    "clear_text_flags": CLEAR_TEXT_FLAGS_SQL,
    "strip_non_ascii": STRIP_NON_ASCII_SQL,
    "trim_text": TRIM_TEXT_SQL,
    "remove_attachments": REMOVE_ATTACHMENTS_SQL,
    "first_last_sentence": FIRST_LAST_SENTENCE_SQL,
    "search_sender_count": SEARCH_SENDER_COUNT_SQL,
    "search_subject_count": SEARCH_SUBJECT_COUNT_SQL,
    "search_body_count": SEARCH_BODY_COUNT_SQL,
    "multi_keyword_counts": MULTI_KEYWORD_COUNTS_SQL,
    "union_all_load": UNION_ALL_LOAD_SQL,
    "thread_sizes": THREAD_SIZES_SQL,
    "thread_first_last": THREAD_FIRST_LAST_SQL,
    "thread_sentences": THREAD_SENTENCES_SQL,
    "thread_count": THREAD_COUNT_SQL,
    "message_numbers": MESSAGE_NUMBERS_SQL,
    "thread_positions": THREAD_POSITIONS_SQL,
    "thread_numbers": THREAD_NUMBERS_SQL,
    "thread_chronological": THREAD_CHRONOLOGICAL_SQL,
    "session_total": SESSION_TOTAL_SQL,
    "unique_names": UNIQUE_NAMES_SQL,
    "sentence_pieces": SENTENCE_PIECES_SQL,
    "search_dates": SEARCH_DATES_SQL,
    "search_regex": SEARCH_REGEX_SQL,
    "search_and_or": SEARCH_AND_OR_SQL,
    "render_messages": RENDER_MESSAGES_SQL,
    "render_threads": RENDER_THREADS_SQL,
    "thread_summaries": THREAD_SUMMARIES_SQL,
    "message_filenames": MESSAGE_FILENAMES_SQL,
    "export_filenames": EXPORT_FILENAMES_SQL,
    "summary_filenames": SUMMARY_FILENAMES_SQL,
    "filename_collisions": FILENAME_COLLISIONS_SQL,
    "sanitize_names": SANITIZE_NAMES_SQL,
    "email_description": EMAIL_DESCRIPTION_SQL,
}
