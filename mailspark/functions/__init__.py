"""Column -> Column functions."""

from .dates import parse_mail_date
from .filenames import (
    export_filename,
    message_filename,
    sanitize_for_filename,
    summary_filename,
    thread_filename,
)
from .text import (
    contains_ci,
    describe_email,
    first_sentence,
    first_sentence_thread_form,
    is_clear_text,
    is_clear_text_strict,
    last_sentence,
    regex_match,
    remove_attachments,
    sentences,
    strip_non_ascii,
    trim_ws,
    trim_ws_nl,
)

__all__ = [
    "contains_ci", "describe_email", "export_filename", "first_sentence", "first_sentence_thread_form",
    "is_clear_text", "is_clear_text_strict", "last_sentence", "message_filename", "parse_mail_date",
    "regex_match", "remove_attachments", "sanitize_for_filename", "sentences", "strip_non_ascii",
    "summary_filename", "thread_filename", "trim_ws", "trim_ws_nl",
]
