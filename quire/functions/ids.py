"""Keys as columns: ids and DOIs in one spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    """The text without blanks around it; null if nothing is left."""
    t = F.regexp_replace(_col(c), r"^\s+|\s+$", "")
    return F.when(t != "", t)


def work_id(c: Column | str) -> Column:
    """An id, given bare or as a link, in either case, with stray blanks: its last path part in
    capitals. Null, empty and blank ids give null."""
    part = F.upper(F.regexp_extract(_col(c), r"([^/\s]+)[/\s]*$", 1))
    return F.when(part != "", part)


def doi_key(c: Column | str) -> Column:
    """A DOI without resolver or ``doi:``, in lower case; null unless it has the form 10.x/y."""
    got = F.lower(F.regexp_extract(_col(c), r"(10\.\d{4,9}/\S+)", 1))
    return F.when(got != "", got)
