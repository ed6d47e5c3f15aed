"""All registered queries and their oracle SQL, merged from the plan modules."""

from __future__ import annotations

from . import files, mail, mbox, replies, usage

QUERIES = {**mail.QUERIES, **mbox.QUERIES, **files.QUERIES, **replies.QUERIES, **usage.QUERIES}
ORACLE_SQL = {**mail.ORACLE_SQL, **mbox.ORACLE_SQL, **files.ORACLE_SQL, **replies.ORACLE_SQL, **usage.ORACLE_SQL}
